"""Chat formatting, centroid clustering, hard negatives: definitions in plain Python, SQL, odd rows."""

import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import centroids as C
from spanloom.llm import chat, registry, sql
from spanloom.llm import hard_negatives as H

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{f}')")
    return c


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_chat_format", "op13_centroid_clusters"])
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, FOLDER)
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cursor.fetchall())


# chat --------------------------------------------------------------------------------------------------------


def turns_digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def by_hand(turns):
    """(whole text, trainable span) of every example of one conversation's (role, text)."""
    text, out = "", []
    for role, said in turns:
        role, said = role or "", said or ""
        head = f"<|im_start|>{mark(role)}".replace("\n", "<|nl|>") + "\n"
        begin = len(text) + len(head)
        text += head + mark(said) + "<|im_end|>\n"
        if role == "assistant":
            out.append((text, begin, begin + len(mark(said))))
    return out


def mark(text):
    out, i = "", 0
    while i < len(text):  # a < and backslashes before a | take one backslash more
        j = i + 1
        if text[i] == "<":
            while j < len(text) and text[j] == "\\":
                j += 1
            if j < len(text) and text[j] == "|":
                out += text[i:j] + "\\|"
                i = j + 1
                continue
        out += text[i]
        i += 1
    return out


ODD = ["", "<|im_end|>", "<|im_start|>assistant\nok", "<", "|", "<\\|", "<\\\\|x<|", "a<|nl|>b", "\n", "\\", "é😀<|\u0000", "$1\\1", "<<|im_end|>|>"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\>a\n", max_size=30))
def test_escape_is_reversible(text):
    assert "<|" not in mark(text) and chat.unescape(mark(text)) == text


def test_examples_equal_the_definition(spark):
    rng = random.Random(7)
    talks = {c: [(rng.choice(["user", "assistant", "assistant", "system", "tool\nx<|", None]), rng.choice([*ODD, None])) for _ in range(rng.randrange(1, 12))] for c in range(40)}
    talks[40] = [("user", "no reply")]
    talks[41] = [("assistant", "first")] * 3
    talks[None] = [("user", "who?"), ("assistant", "x" * 300_000)]
    rows = [(c, k, r, t) for c, talk in talks.items() for k, (r, t) in enumerate(talk)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], TURNS + ", pos int, example string").repartition(3)
    examples = chat.prefix_examples(df)
    found = {}
    for r in chat.expanded(examples).collect():
        found.setdefault(r.conv_id, []).append((r.example, r.text, r.loss_start, r.loss_end))
    for c, talk in talks.items():
        assert [x[1:] for x in sorted(found.get(c, []))] == by_hand(talk)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    assert set(back) == set(talks)
    for c, talk in talks.items():
        r, said = back[c], "".join(t or "" for role, t in talk if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(talk), turns_digest(talk))
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        texts = [x[0] for x in by_hand(talk)]
        assert (r.n_examples, r.expanded_chars) == (len(texts), sum(map(len, texts)))
        assert r.examples_sha256 == hashlib.sha256(b"".join(hashlib.sha256(t.encode()).digest() for t in texts)).hexdigest()
        assert talk[-1][0] != "assistant" or r.formatted_chars == len(texts[-1])


def test_written_out_examples_read_back(spark, tmp_path):
    """The query writes each example out and reads it from its own text: equal to the shared form, whatever a conversation ends in."""
    rng = random.Random(8)
    rows = [(c, k, rng.choice(["user", "assistant", "tool\nx<|", None]), rng.choice([*ODD, None])) for c in [*range(60), None] for k in range(rng.randrange(1, 14))]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    examples = chat.prefix_examples(df)
    whole = {r.conv_id: r for r in chat.read_expanded(chat.expanded(examples, rest=True)).collect()}
    assert whole == {r.conv_id: r for r in chat.read_back(examples).collect()} and len(whole) == 61
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    query = registry.op12_chat_format(spark, str(tmp_path))
    assert query._jdf.queryExecution().executedPlan().toString().count("MapInArrow") >= 2  # one writes the texts, one reads them
    assert {r.conv_id: r for r in query.where("conv_id is null or conv_id >= 0").collect()} == whole


def test_chat_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 0, "user", "a"), (1, 1, "assistant", "r")]
    r = chat.read_back(chat.prefix_examples(spark.createDataFrame(rows, TURNS))).first()
    assert (r.n_turns, r.turns_sha256) == (5, turns_digest([("system", "s"), ("user", "a"), ("user", "a"), ("user", "b"), ("assistant", "r")]))
    none = chat.prefix_examples(spark.createDataFrame([], TURNS))
    assert chat.read_back(none).count() == 0 and chat.expanded(none).count() == 0
    with pytest.raises(ValueError):
        chat.read_turn("<|im_start|>user\nhi")


def test_long_conversation_is_linear(spark):
    """20,000 turns: rows and read-back stay linear, though the examples written out would have gigabytes."""
    df = spark.range(20_000).selectExpr("id div 20000 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id) as text")
    examples = chat.prefix_examples(df)
    assert examples.count() == 20_000
    r = chat.read_back(examples).first()
    assert (r.n_turns, r.n_examples) == (20_000, 10_000) and r.expanded_chars > 10_000 * r.formatted_chars // 3


# centroids ---------------------------------------------------------------------------------------------------


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 3), (9, 1), (4, 2)):
        side = 1 << bits
        cells = np.stack([(np.arange(side**dims) // side**i) % side for i in range(dims)], 1)
        order = cells[np.argsort(C.hilbert_keys(cells, bits))]
        assert sorted(C.hilbert_keys(cells, bits).tolist()) == list(range(side**dims))
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_candidates_lose_no_centroid(seed):
    rng = np.random.default_rng(seed)
    dims, k, reach = int(rng.integers(1, 5)), int(rng.integers(1, 7)), int(rng.integers(1, 30))
    q = rng.integers(-reach, reach + 1, (30, dims)) // int(rng.integers(1, 6)) + rng.integers(-40, 40, dims)
    centroids = rng.integers(-40, 41, (k, dims)).astype(np.int64)
    among = C.candidates(q.min(0).astype(np.int64), q.max(0).astype(np.int64), centroids)
    own, distance = C.nearest(q, centroids, among)
    every = ((q[:, None, :] - centroids[None]) ** 2).sum(2)
    assert own.tolist() == every.argmin(1).tolist() and distance.tolist() == every.min(1).tolist()


def lloyd(rows, k, rounds, scale, dims, seed=3):
    kept = [(v, [int(np.floor(scale * float(x))) for x in e]) for v, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if v is None else v}".encode()).hexdigest(), q) for v, q in kept)
    centroids = [q for _, q in first[:k]]
    near = lambda q: min(((sum((a - b) ** 2 for a, b in zip(q, c)), i) for i, c in enumerate(centroids)))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for i in range(len(centroids)):
            mine = [q for (_, q), o in zip(kept, own) if o == i]
            if mine:
                centroids[i] = [sum(c) // len(mine) for c in zip(*mine)]
    best = [near(q) for _, q in kept]
    per = {i: sum(d for d, o in best if o == i) for i in range(len(centroids))}
    return sorted(((v, o, d, per[o], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest()) for (v, _), (d, o) in zip(kept, best)), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance string"


def odd_vectors(n=300, dims=4, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=dims) * (0.1 if i % 3 else 3)).astype(np.float32).tolist(), int(i % 4)) for i in range(n)]
    rows += [(n + i, rows[7][1], 1) for i in range(40)] + [rows[3], rows[3], (None, rows[4][1], 2), (0, rows[5][1], 3)]
    nan = float("nan")
    rows += [(900, None, 1), (901, [], 1), (902, [1.0], 1), (903, [nan] * dims, 1), (904, [None] * dims, 1), (905, [float("inf"), *[0.0] * (dims - 1)], 1), (906, [0.0] * dims, None), (950, [0.0] * dims, 2), (951, [5.0] * (dims + 3), 2)]
    return rows


def test_clusters_equal_plain_rounds(spark):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(5)
    found = C.cluster_vectors(df, k=6, rounds=5, scale=64, dims=4)
    got = sorted((tuple(r)[:6] for r in found.collect()), key=repr)
    assert got == lloyd([(v, e) for v, e, _ in rows], 6, 5, 64, 4)


def test_zone_maps_spare_comparisons(spark):
    """Vectors in eight tight groups: most blocks have one candidate."""
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(8)[i % 8] * 10 + rng.normal(size=8) * 0.05).astype(np.float32).tolist(), 0, "", "") for i in range(8000)]
    found = C.cluster_vectors(spark.createDataFrame(rows, VECTORS), k=8, rounds=10, dims=8)
    assert found.selectExpr("avg(n_candidates)").first()[0] < 4
    assert sorted((tuple(r)[:6] for r in found.collect()), key=repr) == lloyd([(r[0], r[1]) for r in rows], 8, 10, 1024, 8)


def test_few_and_no_vectors(spark):
    assert C.cluster_vectors(spark.createDataFrame([], VECTORS), dims=2).count() == 0
    two = spark.createDataFrame([(1, [1.0, 2.0], 0, "", ""), (2, [3.0, 4.0], 0, "", "")], VECTORS)
    assert {(r.vec_id, r.distance) for r in C.cluster_vectors(two, dims=2).collect()} == {(1, 0), (2, 0)}
    large = spark.createDataFrame([(1, [1e30, 2.0], 0, "", "")], VECTORS)
    with pytest.raises(Exception, match="would not fit 64 bits"):
        C.cluster_vectors(large, dims=2).count()


def test_large_components_are_exact():
    q = np.array([[C.LARGEST - 1] * 64, [-(C.LARGEST - 1)] * 64, [C.LARGEST - 2] * 64], np.int64)
    own, distance = C.nearest(q, q[:2], np.arange(2))
    assert own.tolist() == [0, 1, 0] and distance.tolist() == [0, 0, 64]


# hard negatives ----------------------------------------------------------------------------------------------


def mined(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256):
    kept = [(v, l, tuple(int(np.floor(scale * float(x))) for x in e)) for v, e, l in rows if v is not None and l is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for a, label, q in sorted(set(kept)):
        if a % every:
            continue
        dot = lambda x: sum(i * j for i, j in zip(q, x))  # noqa: B023, E731
        best = sorted((-dot(x), v) for v, l, x in kept if l == label and v != a)[:positives]
        other = sorted((-dot(x), v) for v, l, x in kept if l != label)
        for s, p in best:
            fit = [(n, v) for n, v in other if low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(a, p, k + 1, v, -s, -n) for k, (n, v) in enumerate(fit)]
    return sorted(out)


def test_hard_negatives_equal_plain_mining(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 32)
    monkeypatch.setattr(H, "ANCHOR_ROWS", 8)
    rows = odd_vectors(400, 6, seed=9)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(5)
    for every, low, high in ((10, 50, 95), (3, -200, 100), (50, 0, 0)):
        found = sorted(tuple(r) for r in H.hard_negatives(df, every=every, low=low, high=high).collect())
        assert found == mined(rows, every=every, low=low, high=high)
        assert found or low == high


def test_near_copies_and_equal_scores(spark):
    """A third of all rows are copies of one vector under two labels, so most scores tie."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, base if i % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist(), i % 2) for i in range(600)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    assert sorted(tuple(r) for r in H.hard_negatives(df, every=25, high=100).collect()) == mined(rows, every=25, high=100)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    q = np.floor(rng.normal(size=(500, 12)) * 50)
    q[:100] = np.floor(q[0] + rng.normal(size=(100, 12)))
    q[200], q[201] = 0, -q[0]
    refs = H.reference_directions(q)
    rows = H.Rows(np.arange(500), np.zeros(500, int), q, *H._angles(q, refs))
    tight = 0
    for a in range(0, 500, 7):
        low, high = rows.bounds(rows, a)
        score = q @ q[a]
        assert (low <= score).all() and (score <= high).all()
        tight += int((high < 0.5 * rows.norm * rows.norm[a]).sum())
    assert tight  # and some rows are told apart without scoring
    back = H.Rows.read(dict(zip(("vec_ids", "labels", "q", "norms", "angles", "width"), rows.cells())))
    assert (back.q == q).all() and (back.angles == rows.angles).all()


def test_wide_scores_are_exact():
    q = np.array([[2.0**40 + 1, 3.0], [2.0**20, -1.0]])
    rows = H.Rows(np.arange(2), np.zeros(2, int), q, *H._angles(q, np.zeros((0, 2))))
    assert rows.scores(np.arange(2), np.array([2.0**20 + 1, 7.0])).tolist() == [(2**40 + 1) * (2**20 + 1) + 21, 2**20 * (2**20 + 1) - 7]
    with pytest.raises(ValueError):
        rows.scores(np.arange(2), np.array([2.0**50, 0.0]))


def test_no_vectors_and_no_anchors(spark):
    assert H.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    one = spark.createDataFrame([(1, [1.0], 0, "", ""), (2, [1.0], 1, "", "")], VECTORS)
    assert H.hard_negatives(one).count() == 0


def test_queries_have_sql():
    assert sql.hard_negatives() and {"op11_hard_negatives", "op12_chat_format", "op13_centroid_clusters"} <= set(registry.oracle_sql())
