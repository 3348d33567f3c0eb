import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import words_of
from pyspark.sql import functions as F

from corpusflow.llm import decontaminate, eliasfano, langid, licenses, lm, packing, queries, url_rules


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def sentences(rng, n, words=60):
    return [" ".join(rng.choice("the a of to".split()) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("universe", [100, 1 << 40, 1 << 64])
def test_elias_fano_round_trip(universe):
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, min(universe, (1 << 63) - 1), 80).astype(np.uint64))
    coded = eliasfano.EliasFano.of(eliasfano.EliasFano.build(values, universe).parts())
    assert (coded.get(np.arange(len(values))) == values).all()
    assert (coded.find(values) == np.arange(len(values))).all()
    absent = np.setdiff1d(values + np.uint64(1), values)
    assert (coded.find(absent[absent < universe]) == -1).all()


def lm_brute(rows):
    """The documented model with plain dictionaries and unquantised probabilities."""
    texts = {i: [*words_of(t), None] for i, t in rows}
    train = {i: w for i, w in texts.items() if crc(i) % 5 != 1}
    uni, bi, tri = Counter(), Counter(), Counter()
    for w in train.values():
        p = ["<s>", "<s>", *w]
        uni.update(w)
        for k in range(2, len(p)):
            bi[p[k - 1], p[k]] += 1
            tri[p[k - 2], p[k - 1], p[k]] += 1
    total, distinct = sum(uni.values()), len(uni)
    by1, by2 = defaultdict(list), defaultdict(list)
    for (v, _), c in bi.items():
        by1[v].append(c)
    for (u, v, _), c in tri.items():
        by2[u, v].append(c)
    out = {}
    for i, w in texts.items():
        p, score, base = ["<s>", "<s>", *w], 0.0, 0.0
        for k in range(2, len(p)):
            u, v, x = p[k - 2], p[k - 1], p[k]
            q = p1 = (uni[x] + 0.5) / (total + 0.5 * (distinct + 1))
            for seen, count in ((by1.get(v), bi[v, x]), (by2.get((u, v)), tri[u, v, x])):
                if seen:
                    q = max(count - lm.DISCOUNT, 0) / sum(seen) + lm.DISCOUNT * len(seen) / sum(seen) * q
            score, base = score + math.log10(q), base + math.log10(p1)
        out[i] = (crc(i) % 5 == 1, len(w), sum(uni[x] > 0 for x in w), total, base, score)
    return out


def test_scores_equal_a_plain_model(docs):
    """One shard and many shards (with heavy words dealt to several) agree with plain dictionaries."""
    rows = list(enumerate([*sentences(random.Random(8), 120), "", None, "The A\x0bof", "unseen words only here"]))
    want = lm_brute(rows)
    for shard_tokens in (2_000_000, 150):
        got = {r.doc_id: r for r in lm.scored(docs(rows), shard_tokens=shard_tokens).collect()}
        assert len(got) == len(rows)
        for i, (held, n, known, total, base, score) in want.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
            assert r.base_score == pytest.approx(base, abs=1e-6)
            assert r.score == pytest.approx(score, abs=0.001 * n + 1e-6)  # 16-bit codes
    assert lm.scored(docs([])).collect() == []


def test_context_helps_on_held_out_texts(docs):
    """Texts whose next word follows from the two before, but for one word in ten."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        w = [rng.randrange(40), rng.randrange(40)]
        for _ in range(30):
            w.append((3 * w[-1] + w[-2]) % 40 if rng.random() > 0.1 else rng.randrange(40))
        rows.append((i, " ".join(f"n{x}" for x in w)))
    got = [r for r in lm.scored(docs(rows)).collect() if r.held_out]
    assert len(got) > 30 and sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_fill_is_the_best_subset(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randrange(1, 40) for _ in range(12))
    capacity = rng.randrange(1, 150)
    got = packing.fill(counts, capacity)
    reach = {0}
    for x, n in counts.items():
        for _ in range(n):
            reach |= {r + x for r in reach if r + x <= capacity}
    assert sum(x * n for x, n in got.items()) == max(reach) and all(n <= counts[x] for x, n in got.items())


def test_packing_covers_every_id_once(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(9)
    odd = ["", None, "Hello, world!! It's re-used; see https://a.b/c?d=e&f #tag 3.14 (ok)", "naïve ÇA ÉTÉ ﬁn 你好 world", "don't can't we'll '' \" `x`", "a\x1cb\x85c\u2003d", "<|endoftext|> x", "word " * 5000, "x" * 3000, "a.b.c...d!?e"]
    rows = list(enumerate([*sentences(rng, 150, 900), *odd]))
    got = packing.packed(docs(rows), with_ids=True).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in rows:
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == want
        assert all(r.doc_tokens == len(want) for r in mine)
        at = 0
        for r in mine:
            assert r.start == at
            at += r.length
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert packing.packed(docs([])).collect() == []


def words8(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def test_encoder_equals_the_plain_tokenizer():
    """Words of letters, marks, symbols and separators of all kinds, in units that are encoded many at once or alone."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(30)
    kinds = ["abcxyzABC", "0123456789", "'.,!?-_()[]:;/&%$#@*", "\u0130\u0131\u00df\u00e9\u00c9\u01c5\u0345", "\u0301\u0307\u0308", "\u00a7\u00b6\u2063", "\u4e2d\u0b95\u0bcd\U0001f600", "\u00a0\u2003\u200b"]
    word = lambda: "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 12))) for _ in range(3000)] + ["", "\u0130.", "AL\u0130, GELD\u0130.", "DEN\u0130ZL\u0130!", "<|endoftext|> A <|startoftext|>b", "it's they'LL \u00a7\u00a7 x\u00a7", "\u00a7"]
    encode = packing.Encoder(None, most_units=500)
    for a in range(0, len(texts), 211):
        part = texts[a : a + 211]
        ids, starts = encode(pa.array(part, pa.string()), 1)
        for k, text in enumerate(part):
            assert ids[starts[k] : starts[k + 1]].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1], text


def test_packing_of_repeated_rows_and_small_pools(spark):
    """Rows that share an id, a null id and equal rows are documents of their own; every token lies in one piece."""
    rows = [(7, "one two three " * 40), (7, "other text"), (7, "other text"), (None, "no id here"), (8, None), (9, "x " * 5000)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, sequence_id int").repartition(1)
    got = packing.packed(df, window=64, pool=2, pool_ids=90).collect()
    assert sorted({r.doc_tokens for r in got if r.doc_id == 7}) == [3, 121] and sum(r.length for r in got if r.doc_id == 7) == 121 + 3 + 3
    assert sum(r.length for r in got if r.doc_id == 9) == 5001 and sum(r.length for r in got if r.doc_id is None) == 4
    sizes = defaultdict(list)
    for r in got:
        sizes[r.sequence_id].append((r.offset, r.length))
    for parts in sizes.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        total = sum(n for _, n in parts)
        assert total == 64 or total & (total - 1) == 0


def test_benchmark_hits_equal_brute_force(spark, docs):
    """Items that share windows, short items, equal items, periodic items; one automaton and several."""
    rng = random.Random(10)
    items = [" ".join(f"t{rng.randrange(60)}" for _ in range(n)) for n in (3, 8, 9, 20, 30, 8)]
    items += [items[3], "a b a b a b a b a b a b", "", None, "one", items[4][:60] + " fork in the road"]
    rows = []
    for _ in range(60):
        parts = [" ".join(f"t{rng.randrange(60)}" for _ in range(rng.randrange(0, 30)))]
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items) or "x").split(" ")
            a = rng.randrange(0, max(1, len(w) - 6))
            parts += [" ".join(w[a:]).upper() + ","]
        rows.append("\n".join(parts))
    rows = list(enumerate([*rows, "", None, "a b " * 40, "ONE"]))
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(None, "no id", "x")], "item_id long, text string, doc_id string")
    windows = defaultdict(set)
    for i, t in enumerate(items):
        w = words8(t)
        n = min(8, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    want = {}
    for i, t in rows:
        w, hit, found = words8(t), set(), set()
        for g, names in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found |= names
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    for most in (1_000_000, 20):
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.scan(docs(rows), bench, max_words=most).collect()}
        assert got == want
    left = {r.doc_id: r for r in decontaminate.clean(docs(rows), bench).collect()}
    assert set(left) == {i for i, x in want.items() if not x[4] and x[1] <= 0.5 * x[0]}
    assert all(r.text == dict(rows)[i] for i, r in left.items() if not want[i][1]) and all(len(words8(r.text)) == want[i][0] - want[i][1] for i, r in left.items())
    assert {tuple(r)[2:4] for r in decontaminate.scan(docs(rows), bench.limit(0)).collect()} == {(0, 0)}
    assert decontaminate.scan(docs([]), bench).collect() == []


def test_licences(docs):
    rows = [(1, "Some text.\nLicensed under the Apache License, Version 2.0."), (2, "All Rights   RESERVED!"), (3, "nothing here of the kind"), (4, ""), (5, None), (6, "Released under the MIT license. Released under the MIT License. " + "word " * 5000)]
    got = {r.doc_id: (r.n_statements, r.licenses) for r in licenses.scan(docs(rows)).collect()}
    assert got == {1: (1, "Apache-2.0"), 2: (1, "proprietary"), 3: (0, None), 4: (0, None), 5: (0, None), 6: (2, "MIT")}
    assert licenses.scan(docs([])).collect() == []


def test_wrapped_and_whole_licences(docs):
    gpl = "# Some tool\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# More."
    mit = 'Copyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above.'
    span = "Some long words stand before what matters here and this tool is\nreleased under the\nMIT License and then there are many more of them without an end"
    rows = [(1, gpl), (2, mit), (3, mit.split("\n\n")[1].replace("\n", " ")), (4, gpl.replace("version 3", "version 2")), (5, gpl.replace("General", "Affero General")), (6, span), (7, "Licensed under\nCC BY-SA 4.0."), (8, gpl.replace("free", "x").replace("License", "y").replace("General", "z").replace("version 3", "w"))]
    got = {r.doc_id: (r.n_statements, r.licenses) for r in licenses.scan(docs(rows)).collect()}
    assert got == {1: (1, "GPL-3.0"), 2: (1, "MIT"), 3: (1, "MIT"), 4: (1, "GPL-2.0"), 5: (1, "AGPL-3.0"), 6: (1, "MIT"), 7: (1, "CC-BY-SA-4.0"), 8: (0, None)}


def test_anchor_words_lose_nothing():
    """Statements at the limit, made by cutting and changing templates, hold an anchor word."""
    rng = random.Random(11)
    known = set(licenses.anchors(licenses.TEMPLATES, 0.8))
    for _, text in licenses.TEMPLATES:
        g = set(licenses.grams_of(text))
        words = text.split(" ")
        for _ in range(200):
            w = [x for x in words if rng.random() > 0.1] + ["zz"] * rng.randrange(0, 3)
            s = set(licenses.grams_of(" ".join(w)))
            if s and 2 * len(s & g) >= 0.8 * (len(s) + len(g)):
                assert known & {x for gram in s for x in gram.split(" ")}


SAMPLES = {"en": "the quick fox and the lazy dog were here with that which", "de": "der schnelle fuchs und die faule katze waren nicht wieder", "fr": "le renard rapide et la chatte paresseuse sont avec vous où"}


def test_language_held_out(docs):
    rng = random.Random(12)
    rows, lang = [], {}
    for i in range(240):
        kind = rng.choice(sorted(SAMPLES))
        rows.append((i, " ".join(rng.choice(SAMPLES[kind].split(" ")) for _ in range(rng.randrange(12, 60)))))
        lang[i] = kind
    rows += [(900, None), (901, ""), (902, "123 !!"), (903, SAMPLES["de"] + " " + SAMPLES["de"] * 300)]
    df = docs(rows, lang)
    got = {r.doc_id: r for r in langid.predict(df, langid.fit(df, ~langid.held_out())).collect()}
    held = [i for i in lang if crc(i) % 4 == 2]
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.95 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in langid.keep_known(df).collect()} >= set(lang)
    assert langid.fit(docs([(1, "no label")]), langid.held_out() | ~langid.held_out()) is None
    assert [tuple(r) for r in langid.predict(docs([(1, "no label")]), None).collect()] == [(1, "und", 0.0)]


def page_brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = lambda s, marks: s[: min([s.find(m) for m in marks if m in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, kind) for kind, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, kind = max(fits, default=(0, None, None))
    return host, path, rule, kind


def test_url_rules(spark):
    urls = ["http://a.Example.COM/en/7x?q#f", "http://x.com/en/1", "https://notcom/en/", "http://example.net/de/8", "http://net/de/8", "http://w.org/es/", "http://w.org/esx", "x", None, "", "http://h?a/b", "ftp://a://b/c", "http:///en/", "http://a\nb.com/en/\nx"]
    urls += [f"http://shop{k}.org/es/item{k}?utm=1" for k in range(60)] + [f"http://shop{k}.io/item{k}?utm=1" for k in range(5)] + [f"http://blog{k}.io/post/{k}" for k in range(60)]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, tokens string")
    got = {r.page_id: r for r in url_rules.judge(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, kind = page_brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == kind if kind else got[i].verdict in ("allow", "block")
    assert url_rules.judge(df.limit(0)).collect() == []
    assert {r.verdict for r in url_rules.judge(df.where("url like '%blog%'")).collect()} == {"allow"}


def test_url_rules_mine_any_token(spark):
    """What alone tells the pages apart is a middle host label, a word of it, a third path segment, a second query key."""
    urls = []
    for bad in ("http://m.casino-win.example.{t}/{d}/a{k}", "http://m.free-pills.example.{t}/{d}/a{k}", "http://m.a.example.{t}/{d}/x/bets", "http://m.b.example.{t}/{d}/y?id={k}&buy=1"):
        urls += [bad.format(t="org", d="es", k=k) for k in range(60)] + [bad.format(t="io", d="it", k=k) for k in range(3)]
    urls += ["http://m.other-pills.example.io/it/a", "http://m.cheap-free.example.io/it/a"]
    urls += [f"http://m.{x}.example.io/it/{y}" for x in "abcd" for y in ("a0", "x/z", "y?id=1", "x")] * 6
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.decided_by) for r in url_rules.judge(df).collect()}
    for i, u in enumerate(urls):
        if ".io/" in u and ("casino" in u or "pills" in u or "free" in u or "bets" in u or "buy" in u):
            assert got[i] == ("block", "mined"), u
        elif ".io/" in u:
            assert got[i] == ("allow", "default"), u


def test_mined_rules_equal_brute_force_counting(spark):
    """Every set of tokens is counted; a URL that no path rule decides is blocked when one of its sets is bad enough."""
    rng = random.Random(77)
    urls = []
    for k in range(220):
        host = rng.choice(["casino-win", "good", "mixed", "poker"]) + rng.choice([".alpha", ".beta", ""]) + rng.choice([".io", ".org", ".net"])
        urls.append(f"http://{host}/{rng.choice(['de', 'es', 'it'])}/{rng.choice(['slots', 'news', 'a1', 'a2'])}" + rng.choice(["", "?ads=1", "?id=4"]))
    urls += [None, "no host", urls[0], urls[0], "http://casino-win.io/" + "x/" * 3000]
    df = spark.createDataFrame([(k if k % 50 else None, u, "t", True) for k, u in enumerate(urls)], "page_id long, url string, tokens string, label boolean")
    host, path = url_rules.host_path(F.col("url"))
    rows = df.select("url", url_rules.tokens(F.col("url"), host, path).alias("t"), url_rules.seeded(url_rules.tokens(F.col("url"), host, path), url_rules.SEEDS).alias("s")).collect()
    sets = {r.url: frozenset(r.t) if page_brute(r.url)[0] else frozenset() for r in rows}
    seeds = {r.url: bool(r.s) and bool(sets[r.url]) for r in rows}
    bad = {u: page_brute(u)[3] == "block" or page_brute(u)[3] is None and seeds[u] for u in sets}
    counted = [u for u in urls if sets[u] or bad[u]]
    least, n = 0.04, len(counted)
    some = {t for t in set().union(*sets.values()) if sum(bad[u] for u in counted if t in sets[u]) >= least * n}
    level, good = [frozenset([t]) for t in some], []
    while level:
        alive = []
        for a in level:
            of = [u for u in counted if a <= sets[u]]
            hits = sum(bad[u] for u in of)
            if hits >= least * n:
                alive.append(a)
                if hits >= 0.9 * len(of):
                    good.append(a)
        level = list({a | b for a in alive for b in alive if len(a | b) == len(a) + 1})
    got = url_rules.judge(df, min_support=least).collect()
    assert len(got) == len(urls)
    seen = Counter()
    want = Counter((page_brute(u)[0], page_brute(u)[1], page_brute(u)[3] or ("block" if any(a <= sets[u] for a in good) else "allow")) for u in urls)
    for r in got:
        seen[r.host, r.path, r.verdict] += 1
    assert seen == want
    assert {"mined", "rule", "default"} == {r.decided_by for r in got}
    for most in (0, 100_000):
        assert Counter((r.host, r.path, r.verdict) for r in url_rules.judge(df, min_support=least, most_broadcast=most).collect()) == want


def test_language_network_equals_plain_loops():
    """The forward pass against plain loops, and windows in blocks against windows at once."""
    rng = np.random.default_rng(3)
    texts = ["short", "x" * 700, "", "\u00e9\u00df " * 90, "a"]
    model = langid.train(texts * 3, ["a", "b", "a", "b", "a"] * 3, window=64, epochs=1)
    blocks, text, real = langid.windows_of(pa.array(texts, pa.large_string()), 64)
    parts = list(langid.window_blocks(pa.array(texts, pa.large_string()), 64, at_once=3))
    assert (np.concatenate([x[0] for x in parts]) == blocks).all() and (np.concatenate([x[1] for x in parts]) == text).all()
    raw = [t.encode() for t in texts]
    assert [bytes(b[:n]) for b, n in zip(blocks, real, strict=True)] == [r[k : k + 64] for r in raw for k in range(0, max(1, len(r)), 64)]
    got = langid.forward(model, blocks)
    each = model.filters.shape[1] // len(langid.WIDTHS)
    for i in rng.choice(len(blocks), 6):
        padded = np.concatenate([blocks[i], np.zeros(langid.WIDEST - 1, np.uint8)])
        h = []
        for f in range(model.filters.shape[1]):
            width = langid.WIDTHS[f // each]
            responses = [sum(float(model.embed[padded[p + j]] @ model.filters[j * 8 : (j + 1) * 8, f]) for j in range(width)) for p in range(64)]
            h.append(max(0.0, max(responses) + float(model.bias[f])))
        z = np.array(h) @ model.out + model.out_bias
        assert np.allclose(got[i], z - np.log(np.exp(z - z.max()).sum()) - z.max(), atol=1e-3)


def test_cleaning_keeps_columns_of_any_name(spark):
    """Names that the operators would use for themselves, in two automata; repeated rows, null ids and a very long text."""
    item = "one two three four five six seven eight nine ten"
    long = "word " * 300_000
    rows = [(1, f"before {item} after some more words that stay here for good and all of it", "m"), (1, "clean text of mine", "m"), (None, long + item, "m"), (2, None, "m"), (2, None, "m")]
    df = spark.createDataFrame([(i, t, "en", x, x, True) for i, t, x in rows], "doc_id long, text string, lang string, _mask string, _ITEMS string, _letters boolean")
    bench = spark.createDataFrame([(k, item if k == 3 else f"other{k} " * 9) for k in range(12)], "item_id long, text string")
    for most in (200_000, 20):
        got = decontaminate.clean(df, bench, max_words=most)
        assert got.columns == df.columns
        texts = sorted(r.text or "" for r in got.collect())
        assert texts == ["", "", "before after some more words that stay here for good and all of it", "clean text of mine", long]
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and {r._mask for r in kept.collect()} <= {"m"}


def test_scores_of_repeated_rows_long_texts_and_clashing_columns(spark):
    """Equal rows and rows with one id each count and are scored; a text of many slices' size is one; null ids train."""
    rng = random.Random(4)
    long = " ".join(f"w{int(rng.paretovariate(0.8)) % 4000}" for _ in range(400_000))
    rows = [(1, "a b c a"), (1, "a b c a"), (1, "other words"), (None, "a b"), (3, long), (4, None)]
    df = spark.createDataFrame([(i, t, True, 7, "h") for i, t in rows], "doc_id long, text string, train boolean, shard int, rows string")
    got = lm.scored(df, shard_tokens=100_000).collect()
    counts = Counter()
    for i, t in rows:
        if i is None or crc(i) % 5 != 1:
            counts.update([*words_of(t), None])
    total, kinds = sum(counts.values()), len(counts)
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {total}
    want = Counter((i, len(words_of(t)) + 1, sum(counts[x] > 0 for x in [*words_of(t), None]), round(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in [*words_of(t), None]), 3)) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in got) == want
    twins = [r.score for r in got if r.doc_id == 1 and r.n_tokens == 5]
    assert len(twins) == 2 and twins[0] == pytest.approx(twins[1], abs=1e-4)


def test_licences_of_repeated_rows_ties_and_long_texts(spark):
    """Each row its own result; of licences with one Dice the first by name is the best; a notice late in a long text counts."""
    mit, cc = "Licensed under the MIT License.", "Licensed under CC BY 4.0."
    rows = [(1, f"{cc}\n{mit}"), (1, f"{cc}\n{mit}"), (None, mit), (2, "word and more. " * 60_000 + "\n" + mit)]
    got = licenses.scan(spark.createDataFrame([(i, t, "l", 1.0) for i, t in rows], "doc_id long, text string, licenses string, found double")).collect()
    assert sorted((r.doc_id or 0, r.n_statements, r.licenses, r.best_license, r.best_dice) for r in got) == sorted([(1, 2, "CC-BY-4.0,MIT", "CC-BY-4.0", 1.0)] * 2 + [(0, 1, "MIT", "MIT", 1.0), (2, 1, "MIT", "MIT", 1.0)])


def test_every_query_is_registered():
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 11))
