import hashlib
import random
import re
import textwrap
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, licenses, media, packing, quality, secrets, warc
from millrace.llm.common import Scratch

WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
CODEC = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))

ODD = ["", "a", "aaaa" * 500, "x<|endoftext|>y <|startoftext|>", "İstanbul ΣΊΣΥΦΟΣ ς Ǆ", "日本語 한국어", "é \x85\x1c\x00 a", "'s 't'll I'VE", "½²ªº", "😀👍🏽", "<|endoftext|", " \n\t"]


@pytest.mark.parametrize("text", ODD)
def test_codec_on_odd_texts(text):
    n, ids, decoded = next(iter(CODEC.rows([text])))
    want = WORDS.encode(text, add_special_tokens=False).ids
    assert (n, ids) == (len(want), " ".join(map(str, want)))
    assert decoded == WORDS.decode(want, skip_special_tokens=False) == CODEC.decode(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_codec_equals_the_library(texts):
    assert CODEC.encode_batch(texts) == [WORDS.encode(t, add_special_tokens=False).ids for t in texts]


def test_merges_that_are_not_in_order():
    # the second rule that makes abc ranks after a rule that uses abc: one place merges at a time
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "d", "ab", "bc", "abc", "abcd"])}
    rules = bpe.MergeTable(vocab, [("b", "c"), ("abc", "d"), ("a", "bc"), ("ab", "c")])
    assert not rules.ordered
    symbols = np.array([vocab[c] for c in "abcdabc"])
    ids, counts = bpe.merge_words(symbols, np.array([7]), rules)
    assert (ids.tolist(), counts.tolist()) == ([vocab["abcd"], vocab["abc"]], [2])


def test_documents_are_encoded(odd_docs, rows, no_docs):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(odd_docs, digests=True).collect())
    want = []
    for d, t in rows:
        ids = WORDS.encode(t or "", add_special_tokens=False).ids
        want.append((str(d), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(WORDS.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    plain = {r.doc_id: r for r in bpe.encode_documents(odd_docs).collect()}
    assert plain[7].decoded == WORDS.decode([int(i) for i in plain[7].ids.split()], skip_special_tokens=False)
    assert bpe.encode_documents(no_docs).count() == 0


def check_packing(pieces, docs):
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_window.setdefault(p.sequence_id, []).append(p)
    for d, t in docs:
        ids = np.array([*BYTES.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[d], key=lambda p: p.start)
        copies = len(own) // len({p.start for p in own})
        at = 0
        for p in own[::copies]:
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_window.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    return sum(p.length for p in pieces), 1024 * len(by_window)


def test_packing(small_docs, odd_docs, rows, no_docs):
    plain = [(r.doc_id, r.text) for r in small_docs.collect()]
    used, room = check_packing(packing.pack_documents(small_docs).collect(), plain)
    assert used > 0.98 * room
    check_packing(packing.pack_documents(odd_docs, with_ids=False).collect(), rows)
    assert packing.pack_documents(no_docs).count() == 0
    piece = packing.pack_documents(odd_docs.filter("doc_id = 7")).first()
    assert np.frombuffer(piece.ids, "<u4").tolist() == [*BYTES.encode("short", add_special_tokens=False).ids, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 256), max_size=80))
def test_differencing_fills_windows(sizes):
    windows = packing.pack_sizes(sizes)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 1024 for w in windows)


def test_differencing_balances():
    rng = random.Random(1)
    sizes = [rng.randint(1, 256) for _ in range(800)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 100)]
    assert max(sums) - min(sums) <= 5
    with pytest.raises(ValueError, match="capacity"):
        packing.pack_sizes([2000])


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets(small_docs, odd_docs, rows, no_docs):
    for docs, plain in ((small_docs, [(r.doc_id, r.text) for r in small_docs.collect()]), (odd_docs, rows)):
        got = {r.doc_id: r for r in secrets.secret_report(docs).collect()}
        for d, t in plain:
            want = base(t or "")
            assert got[d].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert [got[d].n_assign, got[d].n_access, got[d].n_hex] == [want.count(k) for k in ("assign:", "access:", "hex:")]
            assert set(filter(None, want.split(","))) <= set(got[d].spans.split(","))
    assert secrets.secret_report(no_docs).count() == 0


def test_random_strings_and_identifiers():
    models = secrets.train(secrets.labelled_samples())
    rng = random.Random(77)
    for alphabet in secrets.RANDOM_ALPHABETS:
        tokens = ["".join(rng.choices(alphabet, k=24)) for _ in range(300)]
        assert sum(secrets.ratio(t, models) >= secrets.THRESHOLD for t in tokens) >= 0.99 * len(tokens)
    plain = [t for label, t in secrets.labelled_samples(seed=99) if label == "ordinary"]
    assert sum(secrets.ratio(t, models) >= secrets.THRESHOLD for t in plain) <= 0.01 * len(plain)
    text = "key Zk3Qp8LmX2vB7nR5tYw1sDf6 end"
    spans = secrets.model_spans(text, [], models)
    assert [text[s:e] for s, _, e in spans] == ["Zk3Qp8LmX2vB7nR5tYw1sDf6"]
    assert secrets.redacted(text, spans) == "key [SECRET] end"
    assert secrets.redacted("abcdef", [(0, 0, 4), (2, 2, 5)]) == "[SECRET]f"


def test_secrets_behind_words():
    models = secrets.train(secrets.labelled_samples())
    rng = random.Random(78)
    for words in ("", "session_token_value=", "/api/v1/user/session/", "/release/version/image/user/account/"):
        for length, least in ((18, 0.9), (24, 0.99)):
            found = 0
            for _ in range(200):
                text = f"see {words}{''.join(rng.choices(secrets.RANDOM_ALPHABETS[3][:62], k=length))} end"
                found += any(s <= 4 + len(words) and e == len(text) - 4 for s, _, e in secrets.model_spans(text, [], models))
            assert found >= least * 200, (words, length, found)
    plain = [t for label, t in secrets.labelled_samples(seed=99) if label == "ordinary"]
    assert sum(bool(secrets.model_spans(t, [], models)) for t in plain) <= 0.01 * len(plain)


def test_media(odd_docs, rows, no_docs, small_docs):
    for docs, plain in ((odd_docs, rows), (small_docs, [(r.doc_id, r.text) for r in small_docs.collect()])):
        got = sorted(media.media_report(docs).collect(), key=str)
        assert len(got) == len(plain)
        texts = dict(plain)
        for r in got:
            raw = (texts[r.doc_id] or "").encode()
            payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            image = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
            assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(image))
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
            assert r.media_sha256 == hashlib.sha256(image).hexdigest()
            assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert media.media_report(no_docs).count() == 0


def test_chunks_move_with_their_passage(spark):
    rng = np.random.default_rng(3)
    shared = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8)).decode()
    docs = spark.createDataFrame([(1, shared), (2, "something before " + shared), (3, shared)], "doc_id bigint, text string")
    _, store = media.store(docs, Scratch(spark, "test"))
    held = store.select(F.explode("chunks").alias("c")).agg(F.sum(F.octet_length("c.data"))).first()[0]
    assert store.count() == 2  # equal texts share an image
    assert held < 1.3 * len(shared)
    assert media.read_back(store).count() == 2


def test_archives(spark, tmp_path):
    long = "<html>" + "x" * 200 + "</html>"
    rows = [(5, "http://b.example.org/x?q=1", long), (3, "http://www.a.example.org:80/", long), (9, None, None), (4, "http://b.example.org/x?q=1", "short"), (2, "u v", "short"), (None, "http://c/", long), (3, "http://a.example.org/", long), (7, "http://[bad", "é" * 60)]
    pages = spark.createDataFrame([(*r, "p") for r in rows], "page_id bigint, url string, html string, record_type string")
    got = sorted(warc.archive_report(pages).collect(), key=str)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    n = len(long)
    assert by == {5: [("revisit", 3, n)], 3: [("response", None, n)] * 2, 9: [("response", None, 0)], 4: [("response", None, 5)], 2: [("response", None, 5)], None: [("revisit", 3, n)], 7: [("response", None, 120)]}
    assert {r.payload_digest for r in got if r.page_id == 5} == {hashlib.sha256(long.encode()).hexdigest()}
    assert warc.archive_report(pages.limit(0)).count() == 0
    scratch = Scratch(spark, "test")
    segments = warc.write(pages, scratch)
    files = warc.export(segments, str(tmp_path))
    with open(files[0], "rb") as file:
        assert file.read().startswith(b"WARC/1.1\r\n")
    merged = warc.merge_runs(warc.capture_runs(segments), scratch).collect()
    keys = [(r.url_key, r.timestamp) for r in merged]
    assert keys == sorted(keys)
    assert warc.url_key("http://WWW.Example.org:80/A?b=C") == "org,example)/a?b=c"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    merged = list(warc.LoserTree([sorted(r) for r in runs], lambda x: x))
    assert merged == sorted(x for r in runs for x in r)


def test_licenses(spark, odd_docs, rows, no_docs):
    model = licenses.default_model()
    assert model.held_out_accuracy > 0.97
    texts = [n for own in licenses.NOTICES.values() for n in own]
    families = [f for f, own in licenses.NOTICES.items() for _ in own]
    plain = ["The driver showed a license plate at the general station, version two of the story.", "", "Apache helicopters fly over the public library under the terms of the school."]
    docs = spark.createDataFrame([(i, f"Some prose first.\n{t}") for i, t in enumerate(texts + plain)] + [(99, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.license_report(docs).collect()}
    right = sum(got[i].families == f for i, f in enumerate(families))
    assert right >= 0.9 * len(families)
    assert all(got[len(texts) + i].n_licenses == 0 for i in range(3))
    assert got[99].n_licenses == 0
    odd = licenses.license_report(odd_docs).collect()
    assert len(odd) == len(rows)
    assert [(r.families, r.findings) for r in odd if r.doc_id == -4] == [("apache-2.0", "0:apache-2.0")]
    assert licenses.license_report(no_docs).count() == 0


def test_wrapped_licenses(spark):
    notices = [(f, n) for f, own in licenses.NOTICES.items() for n in own if len(n) > 140]
    rows, want = [], []
    for width in (40, 60, 75):
        for mark in ("", "# ", " * "):
            for f, n in notices:
                lines = textwrap.wrap(n, width)
                rows.append((len(rows), "\n".join(["import os", "", *[mark + x for x in lines], "", "def run():", "    return 1"])))
                want.append(f)
    got = {r.doc_id: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].families for i in range(len(rows))] == want


def test_quality_held_out(spark, odd_docs, rows, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality_report(docs, labels)
    joined = out.filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in joined]) > 0.95
    model = quality.fit(docs, labels)
    odd = quality.score(odd_docs, model).collect()
    assert len(odd) == len(rows)
    assert all(0 <= r.quality_score <= 1 for r in odd)
    assert quality.score(no_docs, model).count() == 0
    nothing = labels.limit(0)
    assert quality.fit(docs, nothing) == 0.5
    assert {r.score for r in quality.quality_report(docs.limit(3), nothing).collect()} == {0.5}
    crc = {r.doc_id: r.held_out for r in out.collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in crc.items())


def test_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.random((n, quality.FEATURES)) for n in (1, 3, 2)]
    model = quality.train(bags, np.array([1.0, 0.0, 1.0]), epochs=1)
    begins, label = np.array([0, 1, 4, 6]), np.array([1.0, 0.0, 1.0])
    x = np.concatenate(bags)
    loss = lambda: float(-np.mean(label * np.log(s := model.forward(x, begins)["score"]) + (1 - label) * np.log(1 - s)))
    grads = model.gradients(model.forward(x, begins), begins, label)
    for name in ("w", "v", "u", "t", "c", "d"):
        place = (0,) * model.p[name].ndim
        before = model.p[name][place]
        model.p[name][place] = before + 1e-5
        up = loss()
        model.p[name][place] = before - 1e-5
        down = loss()
        model.p[name][place] = before
        assert grads[name][place] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_passages_cover_whole_texts():
    texts = pa.array(["a" * 1500, None, "é" * 400])
    x, begins = next(iter(quality.passages(texts)))
    assert begins.tolist() == [0, 3, 4, 6]
    assert (x[:, -1] * quality.PASSAGE).round().tolist() == [600, 600, 300, 0, 600, 200]


def test_licenses_by_row_and_brute_force(spark):
    # rows of no or one doc_id are on their own; notices in words and layouts that the training doesn't have
    mit = licenses.NOTICES["mit"][2]
    rows = [(None, "plain words about rivers"), (None, "The file begins here.\n" + mit), (5, "nothing"), (5, "NOTE -- " + licenses.NOTICES["apache-2.0"][1].upper())]
    got = sorted((r.doc_id or 0, r.n_licenses, r.families) for r in licenses.license_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(0, 0, ""), (0, 1, "mit"), (5, 0, ""), (5, 1, "apache-2.0")]
    # single lines scored in Python
    model, names = licenses.default_model(), list(licenses.NOTICES)
    texts = [mit + " and so on", "Public domain software by the author, free to copy.", "We walked by the river.", "License terms of the GNU General Public License apply, version 3 or later.", *[n.replace(",", " ,") + " (see file)" for own in licenses.NOTICES.values() for n in own]]
    at = {g: i for i, g in enumerate(model.vocabulary)}
    want = {}
    for i, t in enumerate(texts):
        words = licenses.tokens(t)
        if len(set(words) & set(model.words)) < 2:
            continue
        own = [at[g] for g in licenses.grams(words) if g in at]
        p = model._softmax(((model.weights[own].sum(axis=0) + model.bias) / model.temperature)[None])[0]  # noqa: SLF001
        k = int(p[1:].argmax())
        family = names[k] if p[k + 1] >= model.least else "unknown"
        bigrams = {g for g in licenses.grams(words) if " " in g}
        share = max((len(bigrams & b) / len(b) for n in licenses.NOTICES.get(family, []) if (b := {g for g in licenses.grams(licenses.tokens(n)) if " " in g})), default=0)
        want[i] = (family, round(float(p[k + 1]), 6), round(share, 6))
    found = licenses.license_paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.family, round(r.probability, 6), round(r.cover, 6)) for r in found} == want


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_every_string_has_a_url_key(text):
    assert isinstance(warc.url_key(text), str)
    assert isinstance(warc.url_key("http://" + text), str)


def test_url_keys_of_no_urls():
    assert warc.url_key("http://a]b/") == "http://a]b/"
    assert warc.url_key("http://[x/") == "http://[x/"
    assert warc.url_key("http://www.Example.com/A?b") == "com,example)/a?b"


def test_secret_overlaps_are_linear():
    text = " ".join(f"token={i:016x}" for i in range(30_000))
    base = secrets.base_spans(text)
    began = time.process_time()
    secrets.model_spans(text, base, secrets.train(secrets.labelled_samples()))
    assert time.process_time() - began < 5
