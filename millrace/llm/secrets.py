"""Secret scans: exact patterns, and character Markov models for random strings that no pattern names.

Two kinds of first-order character models are trained from labelled samples: one for each alphabet of random strings
(hexadecimal, lower-case with digits, base-32, base-64) and one for ordinary identifiers. A token of 20 or more
characters is a secret if the best random model's log-likelihood ratio against the ordinary model, by character,
reaches the threshold; in others of 16 or more the parts are secrets whose ratio does, so that words before a secret
don't hide it. Spans of the patterns always stay; a model span that overlaps one is left out.

Spans are code points, end exclusive, over the whole text. A null text counts as empty; repeated rows give equal rows,
an empty table gives an empty one, extra columns pass through ``scan`` untouched, but for those of its own names.
"""

from __future__ import annotations

import itertools
import math
import random
import re
import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import released, ship

# The patterns, in their order, with the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "random"]

_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Log-likelihood ratio by character from which a token is a secret.
THRESHOLD = 1.5
#: Samples by class and alphabet from which the default models are trained.
SAMPLES = 3000
#: Least characters of a token, of one that is scored as a whole, and of a random part.
LEAST_TOKEN, LEAST_WHOLE, LEAST_RANDOM = 16, 20, 12

_WORDS = (
    "get set user name account value index count list item table column row key map data file path open close read write load save "
    "update delete create insert select from where order group limit offset start end begin stop time date year month day hour "
    "minute second cache client server request response handler session config option default error message event stream batch "
    "process thread queue worker task job schedule retry timeout buffer size length width height color image video audio text "
    "string number integer float double boolean array object class method function return import export module package version "
    "build test debug release main index page view model controller service manager factory builder parser format convert "
    "encode decode encrypt hash sign verify token secret password random generate validate check is has can should will not and "
    "or if else for while the with that this have they which their there about would these other people between international "
    "information development understanding responsibility characteristics representation administration"
).split()
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
RANDOM_ALPHABETS = [string.digits + "abcdef", string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-"]


def labelled_samples(count: int = SAMPLES, seed: int = 11) -> Iterator[tuple[str, str]]:
    """(label, string) pairs: ``random-k`` by alphabet, and ``ordinary`` identifiers in the usual writing styles."""
    rng = random.Random(seed)
    for k, alphabet in enumerate(RANDOM_ALPHABETS):
        for _ in range(count):
            yield f"random-{k}", "".join(rng.choices(alphabet, k=rng.randint(20, 48)))
    styles = [
        lambda w: "_".join(w),
        lambda w: "-".join(w),
        lambda w: "/".join(w),
        lambda w: "_".join(w).upper(),
        lambda w: w[0] + "".join(x.title() for x in w[1:]),
        lambda w: "".join(x.title() for x in w),
        lambda w: "".join(w),
        lambda w: "_".join(w) + f"_{rng.randint(0, 2100)}",
        lambda w: "=" * rng.randint(3, 9) + w[0] + "-" * rng.randint(3, 20),
    ]
    for _ in range(count * 3):
        yield "ordinary", rng.choice(styles)(rng.choices(_WORDS, k=rng.randint(2, 6)))
    for _ in range(count // 6):
        yield "ordinary", rng.choice("=-_+/x0") * rng.randint(20, 40)
        yield "ordinary", "".join(itertools.islice(itertools.cycle(string.digits), rng.randint(0, 9), rng.randint(20, 40)))


def train(samples: Iterable[tuple[str, str]], smoothing: float = 0.05) -> dict[str, dict[str, float]]:
    """Log-probabilities of character pairs by label (the first character after a start mark)."""
    counts: dict[str, dict[str, float]] = {}
    for label, text in samples:
        own = counts.setdefault(label, {})
        for a, b in zip("^" + text, text, strict=False):
            own[a + b] = own.get(a + b, 0) + 1
    models = {}
    for label, own in counts.items():
        totals: dict[str, float] = {}
        for pair, n in own.items():
            totals[pair[0]] = totals.get(pair[0], 0) + n
        space = smoothing * len(ALPHABET)
        models[label] = {a + b: math.log((own.get(a + b, 0) + smoothing) / (totals.get(a, 0) + space)) for a in "^" + ALPHABET for b in ALPHABET}
    return models


def ratio(token: str, models: dict[str, dict[str, float]]) -> float:
    """Log-likelihood ratio by character of the best random model against the ordinary one."""
    pairs = [a + b for a, b in zip("^" + token, token, strict=False)]
    ordinary = sum(models["ordinary"][p] for p in pairs)
    best = max(sum(m[p] for p in pairs) for label, m in models.items() if label != "ordinary")
    return (best - ordinary) / len(token)


def segment(token: str, models: dict[str, dict[str, float]], threshold: float = THRESHOLD) -> tuple[int, int] | None:
    """Start and end of the part of the token that is likeliest random: over all models, the part with the greatest sum of
    log ratios less half the threshold, if its mean reaches the threshold and it has LEAST_RANDOM characters or more."""
    ordinary = models["ordinary"]
    pairs = [a + b for a, b in zip("^" + token, token, strict=False)]
    plain = [ordinary[p] for p in pairs]
    best, found = 0.0, None
    for label, own in models.items():
        if label == "ordinary":
            continue
        ratios = [own[p] - q for p, q in zip(pairs, plain, strict=True)]
        total, start, most, part = 0.0, 0, 0.0, (0, 0)
        for i, r in enumerate(ratios):
            if total <= 0:
                total, start = 0.0, i
            total += r - threshold / 2
            if total > most:
                most, part = total, (start, i + 1)
        n = part[1] - part[0]
        if most > best and n >= LEAST_RANDOM and sum(ratios[part[0] : part[1]]) >= threshold * n:
            best, found = most, part
    return found


def random_parts(token: str, models: dict[str, dict[str, float]], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Starts and ends of the secrets in a token: all of it, or its random parts, widened to the next = or /."""
    out, left = [], [(0, token)]
    while left:
        at, token = left.pop()
        if len(token) < LEAST_TOKEN:
            continue
        if len(token) >= LEAST_WHOLE and ratio(token, models) >= threshold:
            out.append((at, at + len(token)))
            continue
        part = segment(token, models, threshold)
        if part is None:
            continue
        start = max(token.rfind("=", 0, part[0]), token.rfind("/", 0, part[0])) + 1
        end = min((i for i in (token.find("=", part[1]), token.find("/", part[1])) if i >= 0), default=len(token))
        out.append((at + start, at + end))
        left += [(at, token[:start]), (at + end, token[end:])]
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the patterns' matches."""
    found = []
    if _NAMES.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def model_spans(text: str, base: list[tuple[int, int, int]], models: dict, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    found, at = [], 0
    for m in _TOKEN.finditer(text):
        token = m[0]
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        k = at
        while k < len(base) and base[k][0] < m.end() and base[k][2] <= m.start():
            k += 1
        if k < len(base) and base[k][0] < m.end():
            continue
        found += [(m.start() + a, 3, m.start() + b) for a, b in random_parts(token, models, threshold)]
    return found


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones merged, replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text_column: str = "text", threshold: float = THRESHOLD, redact: bool = False, samples: list | None = None) -> DataFrame:
    """Add ``base_spans`` and ``secret_spans`` (strings of kind:start:end) and, with ``redact``, replace the text."""
    ship(docs.sparkSession)
    docs = docs.drop("base_spans", "secret_spans")
    models = train(samples or labelled_samples())
    at = docs.columns.index(text_column)
    schema = docs.schema
    names = [f.name for f in schema.fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, texts = [], [], []
            for text in batch.column(at).to_pylist():
                base = base_spans(text or "")
                every = sorted([*base, *model_spans(text or "", base, models, threshold)])
                first.append(joined(base))
                second.append(joined(every))
                texts.append(redacted(text, every) if every else text)
            columns = list(batch.columns)
            if redact:
                columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first, pa.string()), pa.array(second, pa.string())], [*names, "base_spans", "secret_spans"])

    return docs.mapInArrow(lambda batches: released(run(batches)), f"{kinds}, base_spans string, secret_spans string")


def secret_report(docs: DataFrame) -> DataFrame:
    """By document: the number of base spans by kind, their digest, and all spans."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter(F.split("base_spans", ","), lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), F.col("secret_spans").alias("spans"))
