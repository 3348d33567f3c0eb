import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from conftest_llm import words_of

from corpusflow.llm import lines, neardup, substrings, vectors


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text):
    w = words_of(text)
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()


def near_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(s), roots(sets, near)[i]) for i, s in sets.items()}


def family(rng, base, changes):
    w = list(base)
    for k in rng.sample(range(len(w)), changes):
        w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_equal_brute_force(docs):
    """Families just around the limit, exact copies, chains, one very common text, nulls, empty and short texts."""
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 150]))]
        rows += [family(rng, base, rng.randrange(0, max(2, len(base) // 9))) for _ in range(12)]
    rows += ["the same words again and again"] * 30 + ["The  same\twords AGAIN and again", "", " ", None, "one", "One", "two"]
    rows += [rows[5] + " tail", rows[5].upper()]
    rows = list(enumerate(rows))
    got = neardup.groups(docs(rows), size=2).collect()
    want = near_brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.one_of_each(docs(rows), size=2).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, c) in want.items() if i == c)
    assert kept[0].key == "k"


def test_near_copies_of_little(docs):
    assert neardup.groups(docs([])).collect() == []
    assert [tuple(r) for r in neardup.groups(docs([(7, None), (3, "")])).orderBy("doc_id").collect()] == [(3, 0, 3, True), (7, 0, 7, True)]


def test_near_copies_of_long_texts_and_shared_ids(spark):
    """Texts of many slices' size link; an id that two texts share counts as one document; other columns are not read."""
    rng = random.Random(40)
    words = [f"x{rng.randrange(10**9)}" for _ in range(150_000)]
    rows = [(4, " ".join(words)), (9, " ".join([*words[:-1000], *words[:500]])), (5, "one two three four five six"), (5, "seven eight nine ten eleven"), (7, "one two three four five six")]
    df = spark.createDataFrame([(i, t, 1, b"x", 2) for i, t in rows], "doc_id long, text string, key int, signature binary, component int")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.groups(df).collect())
    assert got == [(4, 4, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 4, False)]


def test_one_of_each_tells_rows_with_one_id_apart(spark):
    """Rows that share an id or have none: one row of each group stays, and no text of its own is lost."""
    text = lambda k: " ".join(f"{k}w{j}" for j in range(40))
    rows = [(1, text("a")), (5, text("unique")), (5, text("a")), (7, text("b")), (7, text("b")), (7, text("b")), (None, text("c")), (None, text("c")), (9, text("c") + " more"), (None, None), (3, None)]
    df = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row int, component_id string")
    got = neardup.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r._row for r in got.collect()) in ([0, 1, b, 8, 9, 10] for b in (3, 4, 5))


def substring_brute(rows, window):
    texts = {i: words_of(t, lower=False) for i, t in rows}
    seen = Counter(tuple(w[k : k + window]) for w in texts.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in texts.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_spans_equal_brute_force(docs):
    """Shared passages at random places, cut short by a word, overlapping in one document, periodic texts."""
    rng = random.Random(4)
    word = lambda: f"x{rng.randrange(3000)}"
    shared = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 90)]
    rows = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += [word() for _ in range(rng.randrange(0, 50))]
            s = rng.choice(shared)
            a = rng.randrange(0, 20)
            parts += s[a:]
        rows.append(" ".join(parts))
    rows += ["a b " * 60, "a " * 80, rows[0], "", None, "short text", rows[1] + "\n" + rows[1], rows[2].upper()]
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed(docs(rows)).collect()}
    assert got == substring_brute(rows, 35)
    assert substrings.removed(docs([])).collect() == []


def lines_brute(rows, documents=10, similarity=0.75, share=0.05, lead=3):
    """Which lines go, by the documented rule, in plain Python."""
    found = []
    for doc_id, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            w = tuple("<*>" if any(c in "0123456789" for c in x) else x for x in words_of(line, lower=False))
            if any(c.isalpha() for x in w for c in x.replace("<*>", "")):
                found.append((doc_id, n, text, w, (len(w), w[:lead])))
    docs, times = defaultdict(set), defaultdict(set)
    for _, _, text, w, leaf in found:
        docs[leaf].add(text)
        times[leaf, w].add(text)
    fields = Counter()
    for (leaf, w), texts in times.items():
        for at, token in enumerate(w):
            fields[leaf, at, token] += len(texts)
    of = defaultdict(list)
    for doc_id, n, text, w, leaf in found:
        constant = [at < lead or fields[leaf, at, x] >= max(documents, share * len(docs[leaf])) for at, x in enumerate(w)]
        general = sum(constant) >= similarity * len(w) and 2 * sum(constant[lead:]) >= len(w) - lead
        of[leaf, general, tuple(x if c or not general else "<*>" for x, c in zip(w, constant, strict=True))].append((doc_id, n, text))
    return {x[:2] for places in of.values() if len({t for _, _, t in places}) >= documents for x in sorted(places)[1:]}


def test_recurring_lines_equal_brute_force(docs):
    rng = random.Random(6)
    say = lambda: " ".join(f"q{rng.randrange(500)}" for _ in range(rng.randrange(2, 9)))
    rows = []
    for k in range(40):
        parts = [say() for _ in range(rng.randrange(1, 6))]
        parts.insert(rng.randrange(len(parts) + 1), f"Posted on {k} May by user{k} in news")
        if k % 3 == 0:
            parts.insert(0, "Read more of this here")
        if k % 5 == 0:
            parts.insert(1, "  Posted\ton 7 May by somebody else entirely ")
        rows.append("\n".join(parts))
    rows += [rows[0]] * 15 + ["", "one line of five words"]
    rows = list(enumerate(rows))
    gone = lines_brute(rows)
    assert gone
    for r in lines.drop_recurring(docs(rows)).collect():
        parts = rows[r.doc_id][1].split("\n")
        assert r._n_lines == len(parts)
        assert r.text == "\n".join(x for n, x in enumerate(parts) if (r.doc_id, n) not in gone)
        assert r.key == "k" and r.id == "x"
    odd = lines.drop_recurring(docs([(1, None), (2, "")])).orderBy("doc_id").collect()
    assert [(r.text, r._n_lines, r._n_dropped) for r in odd] == [(None, 0, 0), ("", 1, 0)]
    assert lines.drop_recurring(docs([])).collect() == [] and lines.keep_with_text(docs([])).collect() == []


def test_lines_of_repeated_rows_null_ids_and_clashing_columns(spark):
    """Equal rows are treated alike, a null id comes last, rows that share an id are told apart, other columns stay."""
    rows = [(k, f"Share this page now\nown text number {'abcdefghijklm'[k]}") for k in range(11)]
    rows += [(0, rows[0][1]), (0, "another text\nShare this page now"), (None, "Share this page now\nwithout an id"), (20, "Share this page now"), (21, None)]
    df = spark.createDataFrame([(i, t, k, k, k, "n", "d") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _gone int, `KEY` int, _id int, _n_lines string, _n_dropped string")
    got = {r._gone: r.text for r in lines.keep_with_text(df).collect()}
    assert lines.keep_with_text(df).columns == df.columns and {r._n_lines for r in lines.keep_with_text(df).collect()} == {"n"}
    assert got[0] == got[11] == rows[0][1] and got[12] == "another text" and got[13] == "without an id" and 14 not in got and got[15] is None
    assert all(got[k] == rows[k][1].split("\n")[1] for k in range(1, 11))


def test_lines_recur_by_documents(docs):
    """A footer's inner lines, one-line documents of a template and short lines go; equal texts count once."""
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.choice("uvwxyz")) for _ in range(n))
    footer = ["Imprint", "We use cookies on this site", "All of it is free", "Read our terms of use"]
    rows = ["\n".join([say(30), *footer, say(30)]) for _ in range(12)]
    rows += [f"Visitor number {k} was here today" for k in range(12)]
    story = [say(12) for _ in range(8)]
    rows += ["\n".join(story)] * 15
    got = {r.doc_id: r.text for r in lines.drop_recurring(docs(list(enumerate(rows)))).collect()}
    assert got[0] == rows[0] and all(got[i] == "\n".join(rows[i].split("\n")[::5]) for i in range(1, 12))
    assert got[12] == rows[12] and all(got[i] == "" for i in range(13, 24))
    assert all(got[i] == rows[i] for i in range(24, 39))


def test_a_leaf_holds_all_its_templates(docs):
    """Two templates of the same length and leading words, the names in them all different."""
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(1000 + k))
    rows = [f"Article written by {word(i)} {word(i + 50)} for the Daily Example" for i in range(12)]
    rows += [f"Article written by our man in {word(i)} last night" for i in range(14)]
    rows += [f"Article written by {' '.join(word(100 + 9 * i + j) for j in range(6))}" for i in range(6)]
    got = {r.doc_id: r._n_dropped for r in lines.drop_recurring(docs(list(enumerate(rows)))).collect()}
    assert got == {i: int(i not in (0, 12) and i < 26) for i in range(len(rows))}


def test_substrings_of_shared_ids_and_long_texts(spark):
    """Rows with one id or none are told apart by their texts; a long text repeats itself; joins without broadcast agree."""
    rng = random.Random(18)
    passage = " ".join(f"p{k}" for k in range(50))
    own = lambda n: " ".join(f"o{rng.randrange(10**9)}" for _ in range(n))
    rows = [(1, own(5) + " " + passage), (1, passage + " " + own(20)), (None, own(40)), (None, passage), (2, own(30_000) + " " + passage + " " + own(30_000) + " " + passage)]
    df = spark.createDataFrame([(i, t, k, 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, least int, times int")
    want = sorted(substring_brute([(k, t) for k, (_, t) in enumerate(rows)], 35).values())
    for most in (500_000, -1):
        got = substrings.removed(df, most_broadcast=most).collect()
        assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)


def test_vectors_find_sparse_links_beside_a_large_group(spark):
    """Hundreds of nodes a label in several shards: a third of them one group, the others pairs and single vectors."""
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (1, 2):
        centre = rng.normal(size=24)
        group = centre + rng.normal(size=(300, 24)) * 0.12
        firsts = rng.normal(size=(250, 24))
        seconds = firsts[:120] + rng.normal(size=(120, 24)) * 0.2
        for v in rng.permutation(np.concatenate([group, firsts, seconds])):
            rows.append((n, [float(x) for x in v.astype(np.float32)], label))
            n += 1
    rows += [(0, rows[5][1], 1), (None, rows[6][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = np.array([r[1] for r in rows[:n]], np.float64)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    labels = np.array([r[2] for r in rows[:n]])
    near = (unit @ unit.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    shared = {0, 5}
    for shard in (2048, 150):
        got = {r.vec_id: r for r in vectors.groups(df, shard=shard).collect() if r.vec_id is not None and r.vec_id not in shared}
        sparse = [i for i in range(n) if 0 < near[i].sum() <= 3 and i not in shared]
        assert len(sparse) > 150 and sum(got[i].n_links == near[i].sum() for i in sparse) >= 0.98 * len(sparse)
        dense = [i for i in range(n) if near[i].sum() > 50 and i not in shared]
        assert len(dense) > 400 and sum(got[i].n_links for i in dense) >= 0.98 * sum(near[i].sum() for i in dense)
        assert all(got[i].n_links <= near[i].sum() + 1 for i in got)
    report = vectors.recall_report(df, shard=150).first()
    assert report.queries > 50 and report.recall >= 0.99


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows, vecs = [], []
    for i in range(500):
        v = (centres[i % 12] + rng.normal(size=16) * rng.choice([0.1, 0.25, 0.35])).astype(np.float32)
        vecs.append(v if i % 9 else vecs[-1] * 2 if vecs else v)
    for i, v in enumerate(vecs):
        rows.append((i, [float(x) for x in v], i % 12 % 5 if i % 40 else None, "extra"))
    rows += [(1000, None, 1, ""), (1001, [0.0] * 16, 1, ""), (1002, [1.0] * 15 + [None], 1, ""), (1003, [float("nan")] * 16, 1, ""), (1004, [float("inf")] * 16, 1, ""), (1005, [1.0, 2.0], 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    good = {i: (np.array(e, np.float64), label) for i, e, label, _ in rows if i < 1000 and label is not None}
    unit = {i: v / np.sqrt(v @ v) for i, (v, _) in good.items()}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and unit[a] @ unit[b] >= 0.93]
    n = Counter(x for pair in links for x in pair)
    want = roots([r[0] for r in rows], links)
    for shard in (2048, 64):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.groups(df, shard=shard, block=50, ef=8).collect()}
        found = sum(x[0] for x in got.values())
        assert all(got[i][0] <= n[i] for i in got) and found >= 0.99 * sum(n.values())
        if found == sum(n.values()):
            assert got == {i: (n[i], c, i == c) for i, c in want.items()}
    assert vectors.groups(df.limit(0)).collect() == []
