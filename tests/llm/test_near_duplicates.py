"""MinHash near-duplicates and fuzzy lines against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa

from spanloom.llm import line_dedup
from spanloom.llm.linking import connected_components
from spanloom.llm.minhash_dedup import near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, component string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "k", "c") for i, t in rows], SCHEMA)


def closure(n, pairs):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus():
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(25):  # families at many distances, one with a hub and many edits
        base = [r.choice(words) for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(1, 9) if k else 40):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append(" ".join(t))
    rows += ["", None, "  \n\t ", "One TWO", "one two", "one two", "x " * 3000, "é É", "é é", " no break"]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_components_equal_brute_force(spark):
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    pairs = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    root = closure(len(rows), pairs)
    got = {r.doc_id: r for r in near_duplicates(docs(spark, rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        assert got[i].n_shingles == len(sets[k])
        assert got[i].component_id == rows[root[k]][0]
        assert got[i].kept == (got[i].component_id == i)


def test_adverse_family_without_links(spark):
    """A shared passage brings many texts into the same buckets; only the truly similar ones are linked."""
    r = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join(passage + [f"u{r.random()}" for _ in range(45)])) for i in range(40)]
    rows.append((100, rows[7][1] + " tail"))
    got = {x.doc_id: x.component_id for x in near_duplicates(docs(spark, rows)).collect()}
    assert {k: v for k, v in got.items() if k != v} == {100: 7}


def test_groups_are_handed_over_whole(monkeypatch):
    import pyarrow as pa

    from spanloom.llm import linking

    monkeypatch.setattr(linking, "CHUNK_ROWS", 7)
    r = random.Random(2)
    rows = sorted((r.randrange(6), r.randrange(2), r.randrange(2), k) for k in range(120))
    seen = []

    def block(task, group):
        got = [tuple(x.values()) for x in task.to_pylist()]
        assert all((a[:3] == b[:3]) == (x == y) for a, b, x, y in zip(got, got[1:], group, group[1:]))
        seen.append({x[:3] for x in got})
        return task.select(["key"])

    cuts = [0, 1, 1, 30, 31, 90, 120]
    batches = [pa.record_batch({c: pa.array([x[k] for x in rows[a:b]], pa.int64()) for k, c in enumerate(("key", "bq", "bx", "id"))}) for a, b in zip(cuts, cuts[1:])]
    assert sum(b.num_rows for b in linking.whole_groups(block)(iter(batches))) == 120
    assert sum(map(len, seen)) == len(set.union(*seen)) and len(seen) > 2


def test_empty_table_and_repeated_rows(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    got = near_duplicates(docs(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None)])).collect()
    assert len(got) == 4
    assert {(x.doc_id, x.component_id) for x in got if x.doc_id} == {(1, 1), (2, 2)}


def test_rows_without_ids_and_clashing_columns(spark):
    """A row without an id joins no group, but takes the component of texts equal to its own; columns of other names are not read."""
    base = " ".join(f"w{k}" for k in range(60))
    near = base.replace("w59", "other")
    rows = [(5, base), (3, near), (None, base), (None, "a text of its own that nobody else has"), (None, None), (9, ""), (None, near)]
    clashing = docs(spark, rows).selectExpr("doc_id", "text", "1 as n_shingles", "'x' as component_id", "2 as kept", "3 as id", "4 as cls", "array(1) as lefts", "'k' as key", "0 as a", "0 as b")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(clashing).collect()), key=repr)
    n = len(shingles(base))
    assert found == sorted([(5, n, 3, False), (3, n, 3, True), (None, n, 3, False), (None, n, 3, False), (None, 5, None, True), (None, 0, None, True), (9, 0, 9, True)], key=repr)


def test_connected_components_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def slow_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        c = [i + 1]
        for j, y in enumerate(b):
            c.append(min(p[j] + (x != y), p[j + 1] + 1, c[-1] + 1))
        p = c
    return p[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abc é") for _ in range(r.randint(0, 40))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == slow_distance(a, b)


def test_simhash_of_long_and_empty_lines():
    long = " ".join(f"w{k % 977}" for k in range(100_000))
    a, b, c, d, e, f = line_dedup.simhashes([long, "", long, "an ox", "an ox ox", "an ox is here there where"])
    assert a == c and b == 0 and d == e
    assert f == line_dedup.simhashes(["where there here here at no"])[0]
    each = line_dedup.simhashes([f"w{k}" for k in range(100, 977)]).view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(each, axis=1, bitorder="little").astype(int).sum(0)
    assert np.packbits(2 * ones > 877, bitorder="little").view(np.int64)[0] == a


def test_lines_equal_brute_force(spark):
    r = random.Random(4)
    words = [f"word{k}" for k in range(300)]
    pool = [" ".join(r.choice(words) for _ in range(r.randint(3, 60))) for _ in range(60)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(r.randint(0, 7)):
            line = r.choice(pool)
            if r.random() < 0.5:
                k = r.randrange(len(line))
                line = line[:k] + r.choice("xyz!") + line[k + 1 :]
            lines.append(line.upper() if r.random() < 0.1 else line)
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, "\n\n"), (202, "a\r\nb"), (203, pool[0] + "\n" + pool[0])]
    occurrences = [(i, p, line_dedup.normal(x)) for i, t in rows for p, x in enumerate((t or "").split("\n"))]
    occurrences = [o for o in occurrences if len(o[2].split()) >= 5]
    forms = sorted({o[2] for o in occurrences})
    sims = line_dedup.simhashes(forms).view(np.uint64)
    pairs = [
        (a, b) for a in range(len(forms)) for b in range(a)
        if np.bitwise_count(sims[a] ^ sims[b]) <= 3 and slow_distance(forms[a], forms[b]) <= max(len(forms[a]), len(forms[b])) * 10 // 100
    ]
    assert pairs
    root, index, seen, gone = closure(len(forms), pairs), {f: k for k, f in enumerate(forms)}, set(), set()
    for i, p, f in sorted(occurrences):
        g = root[index[f]]
        gone |= {(i, p)} if g in seen else set()
        seen.add(g)
    out = line_dedup.dedup_lines(docs(spark, rows).repartition(3))
    assert out.columns[:8] == docs(spark, []).columns
    got = {x.doc_id: x for x in out.collect()}
    for i, t in rows:
        expected = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        assert got[i].text == expected, i
        assert got[i].n_removed == sum(1 for k in gone if k[0] == i)
    assert got[200].n_lines == 0 and got[200].has_own and got[201].text == "\n\n"


def test_lines_with_other_block_counts_agree(spark):
    rows = [(i, f"alpha beta gamma delta epsilon zeta eta theta {'x' * (i % 3)}\nsame line of five words here") for i in range(12)]
    results = [sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs(spark, rows), blocks=b).collect()) for b in (4, 5, 6)]
    assert results[0] == results[1] == results[2]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_meetings_do_not_depend_on_batches():
    import pyarrow as pa

    r = random.Random(17)
    for _ in range(60):
        rows, keys = [], {}
        for k in range(r.randint(0, 12)):
            for i in sorted(r.sample(range(100), r.choice([1, 1, 2, 2, 3, 7]))):
                rows.append((k, i, r.choice([0, 1, 255]), r.choice([20, 21, 40])))
                keys.setdefault(k, []).append(rows[-1])
        expected = []
        for k, members in keys.items():
            for m in members[1:]:
                near, more = (m[2] ^ members[0][2]).bit_count() <= 3 and abs(m[3] - members[0][3]) <= max(m[3], members[0][3]) // 10, len(members) >= 3
                if near or more:
                    expected.append((k, members[0][1], m[1], near, more))
        cuts = sorted(r.sample(range(len(rows) + 1), min(len(rows), r.randint(0, 6)))) if rows else []
        batches = [pa.record_batch({c: pa.array([x[j] for x in rows[a:b]], pa.int64()) for j, c in enumerate(("key", "id", "sim", "size"))}) for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        got = [tuple(x.values()) for b in line_dedup._meetings(3, 90)(iter(batches)) for x in b.to_pylist()]
        assert {g[:4] for g in got} == {e[:4] for e in expected if e[3]} | {g[:4] for g in got if not g[3]}
        # of a bucket with more than two members all but the hub must be seen as such, the far ones without fail
        assert {g[:3] for g in got} >= {e[:3] for e in expected}
        assert {(g[0], g[2]) for g in got if g[4]} >= {(e[0], e[2]) for e in expected if e[4]}


def test_all_words_vote_in_the_registered_query():
    lines = ["an ox ox is by us", " ".join(f"w{k % 977}" for k in range(3000)), "", "one"]
    assert line_dedup.WHOLE["every"]
    got = line_dedup.simhashes(lines, every=True)
    for line, sim in zip(lines, got):
        words = line.split()
        each = line_dedup.simhashes(words, every=True).view(np.uint8).reshape(-1, 8)
        ones = np.unpackbits(each, axis=1, bitorder="little").astype(int).sum(0)
        assert np.packbits(2 * ones > len(words), bitorder="little").view(np.int64)[0] == sim


def test_whole_options_find_what_edit_similarity_alone_finds(spark):
    """No SimHash gate in the brute force: lines with one or two changed words, and Chinese lines."""
    r = random.Random(21)
    letters = "abcdefghijklmnop"
    words = ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(500)]
    forms = []
    for k in range(60):
        base = [r.choice(words) for _ in range(r.randint(8, 60))]
        if k % 6 == 0:
            base = ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(40))]
        forms.append(" ".join(base))
        for _ in range(2):
            t = list(forms[-1])
            for _ in range(r.randint(1, 3) if len(t) > 60 else 1):
                t[r.randrange(len(t))] = r.choice(letters)
            forms.append(" ".join("".join(t).split()))
    forms = sorted({f for f in forms if "a" <= f[0] <= "p" and len(f.split()) >= 5 or f[0] > "z"})
    pairs = [(a, b) for a in range(len(forms)) for b in range(a) if line_dedup.similar(forms[a], forms[b])]
    sims = line_dedup.simhashes(forms).view(np.uint64)
    assert sum(np.bitwise_count(sims[a] ^ sims[b]) > 3 for a, b in pairs) > len(pairs) // 3
    root = closure(len(forms), pairs)
    options = line_dedup.WHOLE | {"least": 1}
    got = {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(docs(spark, list(enumerate(forms))), **options).collect()}
    assert got == {i: int(root[i] != i) for i in range(len(forms))}


def test_short_and_spaceless_lines_take_part(spark):
    rows = [(1, "All rights reserved\nown line\n\n***\n所有权利均予保留"), (2, "ALL rights reserved.\n\n***\n所有权利均予保留\nother"), (3, "end\nend\nbend")]
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup_lines(docs(spark, rows), **line_dedup.WHOLE).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\n***\nother", 2), 3: ("end\nbend", 1)}


def test_unique_short_lines_keep_their_document(spark):
    footer = "this footer stands below every page"
    rows = [(1, footer), (2, f"flour\ntwo eggs\n{footer}"), (3, f"{footer}\n\n--"), (4, f"面粉\n{footer}")]
    for options in ({}, line_dedup.WHOLE):
        got = {x.doc_id: (x.has_own, x.text) for x in line_dedup.dedup_lines(docs(spark, rows), **options).collect()}
        assert got == {1: (True, footer), 2: (True, "flour\ntwo eggs"), 3: (False, "\n--"), 4: (True, "面粉")}


def test_similar_equals_edit_distance():
    r = random.Random(3)
    for _ in range(400):
        a = "".join(r.choice("abc dé面粉\U0001f600") for _ in range(r.randint(0, 90)))
        b = list(a)
        for _ in range(r.randint(0, 12)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 2)] = r.choice(["", "a", "面", "bc"])
        b = "".join(b)
        assert line_dedup.similar(a, b) == (slow_distance(a, b) <= max(len(a), len(b)) * 10 // 100)


def test_runs_of_three_letters_spare_edit_distances_without_loss(monkeypatch):
    """Unlike lines with like letters are told apart before their edit distance, and no similar pair is, whatever its edits."""
    r = random.Random(12)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randint(2, 6))) for _ in range(300)]
    forms = list(dict.fromkeys(" ".join(r.choice(words) for _ in range(r.randint(6, 40))) for _ in range(300)))
    for f in forms[:120]:
        c = list(f)
        for _ in range(r.randint(1, max(1, len(f) // 10))):
            k = r.randrange(len(c))
            c[k : k + r.randint(0, 1)] = r.choice(["", "x", "a", "\U00020000"])
        forms.append("".join(c))
    forms += ["ab" * 900, "ab" * 899, "a", "", "ab"]
    n, asked = len(forms), []
    pairs = {(i, j) for i in range(n) for j in range(n) if i < j and line_dedup.similar(forms[i], forms[j])}
    assert len(pairs) > 90
    length, threes = np.array([len(f) for f in forms]), line_dedup._threes(forms)
    i, j = np.array(sorted(pairs)).T
    assert line_dedup._alike(length[i], threes[i], length[j], threes[j], 90).all()
    monkeypatch.setattr(line_dedup, "similar", lambda a, b, percent: asked.append((a, b)) or False)
    ids = np.arange(n)
    task = pa.table({"key": pa.array(ids * 0), "id": ids, "component": ids, "sim": pa.array(ids * 0), "q": pa.array([True] * n), "x": pa.array([True] * n), "form": forms})
    assert line_dedup._block(64, 90)(task, ids * 0).num_rows == 0
    assert {(forms[i], forms[j]) for i, j in pairs} <= {x for a, b in asked for x in ((a, b), (b, a))} and len(asked) < 2 * len(pairs)


def test_batched_distances_equal_the_plain_ones():
    """pairs told apart many at a time; some end early, some have code points beyond 16 bits, some are long or empty."""
    r = random.Random(31)
    a, b, most = [], [], []
    for _ in range(700):
        letters = r.choice(["ab", "abc dé面粉\U0001f600", "abcdefghij \ufff5\uffff"])
        x = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 3, 20, 60, 150])))
        y = list(x)
        for _ in range(r.randint(0, 14)):
            k = r.randint(0, len(y))
            y[k : k + r.randint(0, 2)] = r.choice(["", "a", "b", "bc"])
        a.append(x)
        b.append("".join(y))
        most.append(r.choice([max(len(x), len(y)) // 10, r.randint(0, 30)]))
    a += ["ab" * 6000, "ab" * 6000]
    b += ["ab" * 5999 + "b", "ba" * 5000]
    most += [1, 5]
    expected = [line_dedup.edit_distance(x, y) <= m for x, y, m in zip(a, b, most)]
    assert line_dedup.within(a, b, np.array(most)).tolist() == expected
    assert 200 < sum(expected) < 600
    assert line_dedup.within([], [], np.zeros(0, np.int64)).tolist() == []


def test_pairs_of_unlike_lines_need_no_distance_of_their_own(monkeypatch):
    """lines a little too far apart, with most runs of three letters in common, are not compared one by one."""
    r = random.Random(8)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randint(2, 6))) for _ in range(200)]
    base = [r.choice(words) for _ in range(60)]
    forms = []
    for _ in range(40):
        line = list(base)
        for k in r.sample(range(60), 9):
            line[k] = r.choice(words)
        forms.append(" ".join(line))
    forms.append(forms[0] + "x")
    n, asked = len(forms), []
    pairs = {(i, j) for i in range(n) for j in range(n) if i < j and line_dedup.similar(forms[i], forms[j])}
    single = line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda a, b, percent: asked.append((a, b)) or single(a, b, percent))
    ids = np.arange(n)
    task = pa.table({"key": pa.array(ids * 0), "id": ids, "component": ids, "sim": pa.array(ids * 0), "q": pa.array([True] * n), "x": pa.array([True] * n), "form": forms})
    links = line_dedup._block(64, 90)(task, ids * 0)
    assert closure(n, zip(links["a"].to_pylist(), links["b"].to_pylist())) == closure(n, pairs)
    assert pairs and len(asked) == links.num_rows
