import math
import random

import brute
import numpy as np
from conftest import SENTENCE

from millrace.llm import lines, minhash
from millrace.llm.common import Scratch
from millrace.llm.embeddings import block_links, near_vectors
from millrace.llm.graph import components
from millrace.llm.lines import dedup_lines, line_groups
from millrace.llm.minhash import near_duplicates, shingle_sets, text_chunks


def expected_lines(rows, k=10, least=20):
    lines = {}
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n") if t is not None else ()):
            norm = line.strip(" ").lower()
            if len(norm) >= least:
                lines[(d, n)] = norm
    order = lambda place: (place[0] is None, place[0] or 0, place[1])
    places = sorted(lines, key=order)
    first, rank = {}, {p: i for i, p in enumerate(places)}
    for p in places:
        first.setdefault(lines[p], p)
    sets = {p: {t[i : i + k] for i in range(max(len(t) - k + 1, 1))} for t, p in first.items()}
    keys = list(sets)
    links = [(rank[a], rank[b]) for i, a in enumerate(keys) for b in keys[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = brute.groups([rank[p] for p in keys], links)
    return {p: places[group[rank[first[t]]]] for p, t in lines.items()}


def test_lines_equal_brute_force(spark, small_docs, odd_docs, rows):
    for docs, plain in ((small_docs, [(r.doc_id, r.text) for r in small_docs.collect()]), (odd_docs, rows)):
        want = expected_lines(plain)
        found = line_groups(docs).collect()
        assert {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in found} == want
        assert all(r.kept == ((r.doc_id, r.line_no) == (r.first_doc_id, r.first_line_no)) for r in found)


def test_lines_are_removed(spark, odd_docs, no_docs):
    out = {r.doc_id: r.text for r in dedup_lines(odd_docs).collect()}
    assert set(dedup_lines(odd_docs).columns) == set(odd_docs.columns)
    assert 2 not in out  # a copy loses all its lines
    assert out[3].strip() == "Something else entirely is written in this line here."
    assert out[1].startswith(SENTENCE)
    assert (out[4], out[5], out[7]) == (None, "", "short")
    assert None not in out
    assert dedup_lines(no_docs).count() == line_groups(no_docs).count() == 0


def test_lines_of_any_length(spark):
    plain = [(1, "ab\nlong enough to have shingles\n  \n{"), (2, "AB\nab c\n{\n0123456789x\n😀😀😀😀😀😀😀😀😀😀😀"), (3, "0123456789y\nab")]
    docs = spark.createDataFrame(plain, "doc_id bigint, text string")
    got = {(r.doc_id, r.line_no): ((r.first_doc_id, r.first_line_no), r.group_lines, r.kept) for r in line_groups(docs, min_chars=1).collect()}
    want = expected_lines(plain, least=1)
    assert {p: g[0] for p, g in got.items()} == want
    assert (got[(3, 1)], got[(2, 2)]) == (((1, 0), 3, False), ((1, 3), 2, False))
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == dict(plain)


def test_rows_of_one_doc_id_keep_their_own_text(spark):
    line, other = SENTENCE, "A line that is found in one place only, of the second row of the document."
    rows = [(1, line, "a", 1), (2, line, "b", 2), (2, other, "c", 3), (None, line, "d", 4), (None, other + " More.", "e", 5), (None, "Rivers and woods, and nothing else.", "f", 6), (None, "Rivers and woods, and nothing else.", "f", 7), (None, "Rivers and woods, and nothing else.\nEnd", "g", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lost string, `__lost` int").withColumnRenamed("lost", "t1")
    out = sorted((r.doc_id or 0, r.text, r.t1) for r in dedup_lines(docs).collect())
    assert dedup_lines(docs).columns == docs.columns
    # of two null rows with one line the one with the smaller hash keeps it; equal rows are one
    rivers = [x for x in out if x[2] in "fg"]
    assert [x for x in out if x[2] not in "fg"] == [(1, line, "a"), (2, other, "c")] or [x for x in out if x[2] not in "fg"] == [(0, other + " More.", "e"), (1, line, "a"), (2, other, "c")]
    assert sum("Rivers" in x[1] for x in rivers) in (1, 2)
    assert sum(x[2] == "g" for x in rivers) == 1


def test_similar_lines_of_one_head(spark):
    # lines with a common head, alike at 0.758, each with a partner at 0.807 or more
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    head, rows = letters(260), []
    for d in range(200):
        own = head + letters(41)
        rows += [(2 * d, own), (2 * d + 1, own[:-32] + letters(32))]
    got = {r.doc_id: r.first_doc_id for r in line_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {p[0]: f[0] for p, f in expected_lines(rows).items()}
    planted = [d for d in want if want[d] != d]
    assert len(planted) >= 200
    assert sum(got[d] == want[d] for d in planted) >= 0.97 * len(planted)
    assert all(got[d] == d for d in want if want[d] == d)


def test_similar_lines_in_a_crowded_bucket(spark):
    # a template whose copies are alike below 0.8, and pairs of 0.8 and more among them
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    fixed = letters(300)
    rows = []
    for d in range(150):
        own = fixed + letters(50)
        rows += [(2 * d, own), (2 * d + 1, own[:-10] + letters(10))] if d % 5 == 0 else [(2 * d, own)]
    want = expected_lines(rows)
    assert sum(p != f for p, f in want.items()) == 30
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in line_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_sketches_rule_out_long_lines_and_no_near_ones(spark):
    # in 900 and more shingles; one bit map of 512 bits for all lengths, as before, is full there and rules nothing out
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    rows = []
    for d in range(40):
        own = letters(1500)
        rows += [(3 * d, own), (3 * d + 1, own[:-160] + letters(160)), (3 * d + 2, own[:-300] + letters(300))]
    rows += [(1000, "ab" * 400), (1001, "ab" * 900)]  # repeats, one set
    sets = {d: {t[i : i + 10] for i in range(len(t) - 9)} for d, t in rows}
    ratio = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = [(3 * d, 3 * d + 1) for d in range(40)] + [(1000, 1001)]
    far = [(3 * d, 3 * d + 2) for d in range(40)]
    assert min(ratio(*p) for p in near) >= 0.8 and max(ratio(*p) for p in far) < 0.7
    sketches = lines._sketches(spark.createDataFrame(rows, "id bigint, norm string"), 10)  # noqa: SLF001
    assert {r.id: r.bits.n for r in sketches.collect()} == {d: len(x) for d, x in sets.items()}
    left = {(r.u, r.v) for r in lines._likely(spark.createDataFrame(near + far, "u bigint, v bigint"), sketches, 80).collect()}  # noqa: SLF001
    assert left >= set(near)
    assert len(left & set(far)) <= 4


def test_a_family_is_joined_without_comparing_all_its_pairs(spark, monkeypatch):
    # near copies of one line, many of whose pairs are alike at 0.8 and more; of each bucket's centers too few are
    rng = random.Random(3)
    base = rng.choices("abcdefghijklmnopqrstuvwxyz", k=800)
    rows = []
    for d in range(300):
        own = list(base)
        for at in rng.sample(range(800), rng.choice((4, 5))):
            own[at] = rng.choice("0123456789")
        rows.append((d, "".join(own)))
    compared, confirm = [], lines._confirm  # noqa: SLF001

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(lines, "_confirm", counted)
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in line_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == expected_lines(rows)
    assert sum(compared) < 8 * len(rows)  # 14,942 when all pairs of different groups were


def test_a_line_is_lowered_once(spark, small_docs):
    # in the plan that hashes it: not again in the filter on its length, or for each hash
    plan = lines._lines(small_docs, 1).agg({"k1": "max", "k2": "max"})._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert plan.count("lower(") == 1


def test_the_texts_are_not_split_again_for_the_result(spark, small_docs):
    # it is made from lines that were written with their classes
    plan = line_groups(small_docs, min_chars=1)._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "split(" not in plan and "lower(" not in plan and "xxhash64(text" not in plan


def test_lines_equal_brute_force_where_nothing_is_broadcast(spark, odd_docs, rows, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_KEYS", 0)
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in line_groups(odd_docs).collect()}
    assert got == expected_lines(rows)


def test_lines_at_the_least_length(spark):
    # of characters of one, two and four bytes
    plain = [(10 * n + k, c * n) for n in (18, 19, 20, 21, 79, 80) for k, c in enumerate(("a", "é", "😀"))]
    got = lines._lines(spark.createDataFrame(plain, "doc_id bigint, text string"), 20)  # noqa: SLF001
    assert {r.doc_id for r in got.collect()} == {d for d, t in plain if len(t) >= 20}


def test_documents_equal_brute_force(spark, small_docs):
    got = {r.doc_id: r for r in near_duplicates(small_docs, words=4).collect()}
    group, sets, _ = brute.near_groups([(r.doc_id, r.text) for r in small_docs.collect()], 4)
    assert {d: r.component_id for d, r in got.items()} == group
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(s) for d, s in sets.items()}
    assert all(r.kept == (d == r.component_id) for d, r in got.items())


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(300):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(own)))
    rows += [(1000 + d, " ".join(f"y{rng.randrange(10**6)}" for _ in range(60))) for d in range(50)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=4).collect()}
    group, _, _ = brute.near_groups(rows, 4)
    assert got == group


def test_similar_documents_in_a_large_family(spark):
    # a template whose copies are alike below 0.8, and pairs of 0.8 and more among them
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    fixed = words(183)
    rows = []
    for d in range(2000):
        own = fixed + words(27)
        rows.append((2 * d, " ".join(own)))
        if d % 25 == 0:
            rows.append((2 * d + 1, " ".join([*own[:-21], *words(21)])))
    x, y, z = (brute.word_shingles(t, 4) for _, t in rows[:3])
    assert len(x & y) >= 0.8 * len(x | y)
    assert len(x & z) < 0.8 * len(x | z)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=4).collect()}
    assert got == {d: d // 2 * 2 for d, _ in rows}


def test_sketches_rarely_rule_out_a_pair_at_the_threshold():
    least, _ = minhash._bounds(0.8)  # noqa: SLF001
    assert sum(math.comb(minhash.TOKENS, k) * 0.8**k * 0.2 ** (minhash.TOKENS - k) for k in range(least)) < 1e-5


def test_odd_documents(spark, odd_docs, no_docs):
    got = {}
    for r in near_duplicates(odd_docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(r.component_id, r.kept) for r in got[1]] == [(1, True)] * 2
    assert (got[2][0].component_id, got[2][0].kept) == (1, False)
    assert [(got[d][0].n_shingles, got[d][0].component_id, got[d][0].kept) for d in (4, 5, 6)] == [(0, 4, True), (0, 5, True), (0, 6, True)]
    assert got[7][0].n_shingles == 1
    assert (got[None][0].component_id, got[None][0].kept) == (None, True)
    assert near_duplicates(no_docs).count() == 0


def test_shingles_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["Ab c  d\te", None, "", "ab\nC d e", "one two", "\x0bxÉ y z w v"]
    every = [s.tolist() for s in shingle_sets(pa.array(texts), 4)]
    assert every == [next(iter(shingle_sets(pa.array([t], pa.string()), 4))).tolist() for t in texts]
    assert every[0] == every[3]
    assert [len(s) for s in every] == [len(brute.word_shingles(t, 4)) for t in texts]
    assert [(a, b) for a, b, _, _ in text_chunks(pa.array(texts).slice(1, 3))] == [(0, 3)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "test")).collect()}
    assert out == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, *range(200, 230)], 100)}


def test_counts_find_vectors_at_the_threshold():
    # 64 dimensions, partners at cosine 0.9 and a little more, between unlike vectors
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    other = rng.standard_normal(x.shape)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.sqrt((other * other).sum(axis=1, keepdims=True))
    y = 0.9001 * x + math.sqrt(1 - 0.9001**2) * other
    found = {(i, int(j)) for i, own in block_links(x, y, 0.9, False) for j in own}
    assert all(x[i] @ y[j] >= 0.9 for i, j in found)
    assert sum((i, i) in found for i in range(3000)) >= 2997


def test_vectors_of_one_direction_are_dealt_in_blocks(spark):
    rows = [(i, [1.0 + i, 0.0, 0.0]) for i in range(90)] + [(100 + i, [0.0, 1.0 + i, 1.0 + i * i]) for i in range(9)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), block=16).collect()}
    assert {got[i] for i in range(90)} == {(89, 0)}
    x = np.array([v for _, v in rows])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    assert [got[v][0] for v, _ in rows] == ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((6, 24))
    x = np.concatenate([c + rng.standard_normal((30, 24)) * 0.32 for c in centers]).astype(np.float32)
    x[5] = x[4]
    x[7] = 3 * x[6]
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [None] * 24, 0), (904, [], 0), (905, [1.0, 2.0], 0), (906, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r for r in near_vectors(frame, block=64).collect()}
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    group = brute.groups(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    assert near.sum() > 100
    missed = sum(abs(got[i].n_links - int(n)) for i, n in enumerate(near.sum(axis=1)))
    assert missed <= 0.001 * near.sum()
    assert [got[i].component_id for i in range(len(x))] == [group[i] for i in range(len(x))]
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in (900, 901, 902, 903, 904)] == [(0, i, True) for i in (900, 901, 902, 903, 904)]
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in (905, 906, None)] == [(1, 905, True), (1, 905, False), (0, None, True)]
    assert near_vectors(frame.limit(0)).count() == 0
