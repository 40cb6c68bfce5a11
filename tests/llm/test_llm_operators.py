import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lakescope.llm import components as components_module
from lakescope.llm import exactdedup, html, katz, langid, mixing, packing, queries, simhash, substring, tokencount, topk

DOC = "doc_id long, text string, lang string, source string"
#: Columns whose names the operators use inside.
CLASH = ("score", "lang_pred", "_text", "held_out", "_source", "_target", "_source_size", "_rate", "_copies", "_keep", "_found", "_digest", "keep_id", "uid", "n", "node", "fp", "row", "chunk", "bucket", "body", "_size", "count", "digest", "component", "source_size", "best")


def prose(rng, n, vocabulary=60):
    return " ".join(rng.choice(["Alpha", "beta", "gämma", "delta,", "ε"]) + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, exact and near copies, shared passages, periodic text, ties, repeated rows."""
    rng = random.Random(5)
    passage, base = prose(rng, 45), prose(rng, 120)
    texts = [None, "", " \t\n", "one", "Two words", base, base, base.upper(), base.replace("Alpha1", "Alpha2", 1), "a b " * 60, passage, "x   y", "line\x0bfeed\x0cand\x1fmore", "<|endoftext|> a<|startoftext|>B <|ENDOFTEXT|> x<|endoftext|><|startoftext|", "no\u00a0blank,日本語のテキスト。e\u0301J\u030c'S1234ǅİ" * 30, "'re<|endoftext|>\u3000é't\x1f", "!!! 123 ...", prose(rng, 3000)]
    texts += [prose(rng, rng.randrange(1, 80)) + " " + (passage if k % 2 else "") + " " + prose(rng, 10) for k in range(24)]
    out = [(k, t, ("en", "de", None)[k % 3], ("s1", "s2", None, "é")[k % 4]) for k, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, (None, base, "en", "s1"), (7, base, "en", "s1"), (7, base, "en", "s1"), (-3, passage, "de", "s2"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, DOC).repartition(3)
    for c in CLASH:
        frame = frame.withColumn(c, F.lit("clash"))
    return frame.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def same(got, want):
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_exact_dedup(docs, rows, empty):
    for keep, best in (("largest", max), ("smallest", min)):
        groups = defaultdict(list)
        for r in rows:
            groups[r[1] or ""].append(r[0])
        key = lambda i: -(10**9) if i is None else i
        got = exactdedup.exact_groups(docs, keep=keep).collect()
        want = [(r[0], best(groups[r[1] or ""], key=key), len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows]
        same([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], want)
        assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(set(r["text_sha256"] for r in got))
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
        out = exactdedup.exact_dedup(docs, keep=keep)
        assert out.columns == docs.columns
        same([(r["doc_id"], r["text"] or "") for r in out.collect()], [(best(v, key=key), t) for t, v in groups.items()])
    assert exactdedup.exact_groups(empty).count() == 0 == exactdedup.exact_dedup(empty).count()


@pytest.mark.parametrize(("run", "range_", "hot", "few"), [(3, 4, 1, 0), (1, 1000, 10_000, 0), (1000, 1, 0, 1000)])
def test_exact_dedup_in_many_runs(docs, monkeypatch, run, range_, hot, few):
    """Small runs, many rounds and ranges, and groups met by broadcast give what one run gives."""
    def results():
        return [sorted(map(repr, f.collect())) for f in (exactdedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "text_sha256"), exactdedup.exact_dedup(docs).select("doc_id", F.coalesce("text", F.lit(""))))]

    whole = results()
    for name, value in (("RUN", run), ("RANGE", range_), ("HOT", hot), ("FEW", few)):
        monkeypatch.setattr(exactdedup, name, value)
    assert results() == whole


def test_runs_keep_collisions_apart():
    """Equal digests with other lengths or second hashes are other texts; the best id of each stays at every level."""
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(2), rng.randrange(2), rng.randrange(9), k) for k in range(400)]
    for largest in (False, True):
        runs = []
        for i in range(0, 400, 40):
            a = np.zeros(40, exactdedup.ENTRY)
            for j, (d, c, b, doc, uid) in enumerate(rows[i : i + 40]):
                a[j] = (7, 7, 7, d, c, b, doc == 8, 0 if doc == 8 else doc, uid, 1, 1)
            runs.append(exactdedup.merge([a], largest))
        while len(runs) > 1:
            runs = [exactdedup.merge(runs[k : k + 3], largest) for k in range(0, len(runs), 3)]
        got = {(int(e["d3"]), int(e["check"]), int(e["n_bytes"])): (-1 if e["null"] else int(e["doc_id"]), int(e["n"]), int(e["same"])) for e in runs[0]}
        groups = defaultdict(list)
        for d, c, b, doc, _ in rows:
            groups[d, c, b].append(-1 if doc == 8 else doc)
        assert got == {k: ((max if largest else min)(v), len(v), v.count((max if largest else min)(v))) for k, v in groups.items()}


def test_fingerprints(rows):
    for r in rows:
        assert simhash.fingerprint((r[1] or "").encode()) % 2**64 == brute.fingerprint(r[1])


def test_near_groups(docs, rows, empty):
    got = simhash.near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    same(got, brute.near_groups(rows))
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    stays = {g[0] for g in brute.near_groups(rows) if g[0] is None or g[0] == g[2]}
    same([(r["doc_id"], r["text"]) for r in kept.collect()], [(r[0], r[1]) for r in rows if r[0] in stays])
    assert simhash.near_groups(empty).count() == 0 == simhash.near_dedup(empty).count()


@pytest.mark.parametrize(("groups", "local"), [(24, 1 << 20), (2, 0)])
def test_links_over_tiles(spark, monkeypatch, groups, local):
    """Chains of links within and across tiles and cells, against all pairs."""
    monkeypatch.setattr(simhash, "TILE", 50)
    monkeypatch.setattr(simhash, "GROUPS", groups)
    monkeypatch.setattr(components_module, "LOCAL", local)
    rng = random.Random(8)
    prints = set()
    while len(prints) < 300:
        p = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            prints.add(p)
            for _ in range(rng.randrange(1, 4)):
                p ^= 1 << rng.randrange(64)
    prints = [p - 2**64 if p >> 63 else p for p in prints]
    from lakescope.llm.components import components

    frame = spark.createDataFrame([(p, p) for p in prints], "node long, fp long")
    got = {r["node"]: r["component"] for r in components(simhash.links(frame)).collect()}
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert all(got.get(p, p) == find(p) for p in prints) and len({find(p) for p in prints}) < len(prints)


def test_mixing(docs, rows, empty, spark):
    out = mixing.copies(docs, mixing.words()).select("row.source", "copies", "target", "source_size").collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(brute.words(r[1]))
    want = brute.targets(list(size.items()))
    assert len(out) == len(rows)
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["copies"] <= 2
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mix(empty).count() == 0
    zero = spark.createDataFrame([(1, None, "en", "s"), (2, "", "en", None)], DOC)
    assert mixing.mix(zero).count() == 0


def test_mixing_many_sources(docs, monkeypatch):
    """Beyond the sources that are broadcast, the salted join takes the same."""
    take = lambda: sorted(map(repr, mixing.copies(docs, mixing.words()).select("row.doc_id", "row.text", "target", "copies").collect()))
    few = take()
    monkeypatch.setattr(mixing, "FEW", 0)
    assert take() == few


def test_mixing_levels(spark):
    rng = random.Random(2)
    for _ in range(6):
        sizes = [(f"s{k}", rng.choice([0, 1, 10, 1000, 10**6])) for k in range(rng.randrange(1, 9))]
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        assert got == pytest.approx(brute.targets(sizes))


def test_mix_comes_near_targets(spark):
    frame = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"), (F.col("id") % 97).alias("size"))
    r = mixing.copies(frame, F.col("size")).groupBy("row.source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"), F.first("target").alias("want")).collect()
    assert all(abs(x["got"] / x["want"] - 1) < 0.05 for x in r)


def test_katz(docs, rows, empty):
    got = katz.scored(docs, langid.held_out(7, 2)).collect()
    named = [("null" if r[0] is None else r[0], *r[1:]) for r in rows]
    want, p2, uni, follow = brute.katz(named)
    key = lambda r: (str(r[0]), r[2], r[3], round(r[6], 6))
    got = sorted((("null" if r[0] is None else r[0], *r[1:]) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    unknown = object()
    for context in [None, *list(uni)[:20], b"never seen"]:
        assert sum(p2(context, w) for w in [*uni, unknown]) == pytest.approx(1)
    assert katz.scored(empty, langid.held_out(7, 2)).count() == 0
    untrained = katz.scored(docs, F.lit(True)).collect()
    assert all((r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0) and abs(r["score"]) < 1e-12 for r in untrained)


def test_katz_frequent_contexts(docs, rows, monkeypatch):
    """A first word that is split over partitions scores as before."""
    plain = sorted(map(tuple, katz.scored(docs.filter("doc_id is not null"), langid.held_out(7, 2)).collect()))
    monkeypatch.setattr(katz, "HOT", 3)
    split = sorted(map(tuple, katz.scored(docs.filter("doc_id is not null"), langid.held_out(7, 2)).collect()))
    assert [r[:5] for r in split] == [r[:5] for r in plain]
    assert [r[6] for r in split] == pytest.approx([r[6] for r in plain])


def vectors(rng):
    rows = [(k, [rng.uniform(-2, 2) for _ in range(8)]) for k in range(300)]
    rows += [(300 + k, rows[0][1]) for k in range(40)] + [(0, rows[3][1]), (400, None), (401, []), (402, [1.0, None] * 4), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, rows[0][1]), (405, [1.0] * 3), (450, [2.0] * 3), (500, [1e30] * 3)]
    return rows


def test_top_k(spark, monkeypatch):
    rows = vectors(random.Random(4))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("uid", F.lit("clash"))
    plain = [r for r in rows if r[0] != 500]
    for tile in (2048, 32):
        monkeypatch.setattr(topk, "TILE", tile)
        got = topk.top_k(frame.filter("vec_id is null or vec_id <> 500"), lambda c: c % 50 == 0, k=7)
        same(got.collect(), brute.top_k(plain, 50, 7))
    assert topk.top_k(frame.limit(0), lambda c: c % 50 == 0).count() == 0
    big = topk.top_k(frame.filter("vec_id in (405, 450, 500)"), lambda c: c % 50 == 0).collect()
    assert sorted(big)[-1]["score"] <= 2**63 - 1 and len(big) == 4


def test_lists_are_read_in_part():
    """On vectors with structure the bounds meet before the lists end; a known k-th score ends it sooner; results are exact."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.exponential(40, (2000, 12)) ** 2)
    asked, none = np.arange(0, 400, 20), np.full(20, -np.inf)
    lists = topk.Lists(x)
    found = topk.search(lists, x[asked], asked, 5, none)
    want = x[asked] @ x.T
    want[np.arange(20), asked] = -1
    for (at, scores, _), w in zip(found, want, strict=True):
        best = np.lexsort((np.arange(2000), -w))[:5]
        assert at.tolist() == best.tolist() and scores.tolist() == w[best].tolist()
    assert np.mean([depth for *_, depth in found]) < 0.6 * 2000
    sooner = topk.search(lists, x[asked], asked, 5, want.max(axis=1) + 1)
    assert all(len(at) == 0 for at, *_ in sooner) and np.mean([depth for *_, depth in sooner]) < np.mean([depth for *_, depth in found])


def test_token_counts(docs, rows, empty):
    path = queries.vocabulary()
    t = tokencount.load(path)
    got = tokencount.token_counts(docs, path).collect()
    same(got, [(r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows])
    assert tokencount.token_counts(empty, path).count() == 0
    with pytest.raises(ValueError):
        tokencount.token_counts(empty, queries.vocabulary("byte_bpe_50k.json"))


def test_pre_tokens_of_odd_runs():
    """Every character below the plain limit and many above, alone and among others, against the library."""
    path = queries.vocabulary()
    t, rng = tokencount.load(path), random.Random(4)
    singles = [chr(c) for c in range(0x21, 0x3000) if chr(c).split()]
    runs = singles + ["".join(rng.choice(singles[:300]) for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + ["".join(rng.choice(singles) for _ in range(5)) for _ in range(2000)]
    encoder = packing.Encoder(path)
    for odd in ([], ["a<|endoftext|>b", "<|startoftext|>"]):
        texts = [w.encode() for w in runs + odd]
        ids, sizes = encoder.encode(texts)
        want = [t.encode(w, add_special_tokens=False).ids for w in runs + odd]
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_packing(docs, rows, empty):
    path, capacity = queries.vocabulary(), 256
    t = tokencount.load(path)
    ids = sorted([*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows)
    pieces = packing.packed(docs, path, capacity).collect()
    places, texts = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert 0 < p["length"] <= capacity and len(p["ids"]) == 4 * p["length"] and p["start"] == p["piece"] * capacity
        places[p["sequence_id"]].append((p["offset"], p["length"]))
        texts[p["doc_id"]].append((p["piece"], np.frombuffer(p["ids"], "<u4").tolist()))
    for spots in places.values():
        spots.sort()
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))] and sum(n for _, n in spots) <= capacity
    once = Counter(r[0] for r in rows)
    whole = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    for doc, parts in texts.items():
        if once[doc] == 1:
            assert [i for _, p in sorted(parts) for i in p] == whole[doc]
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    assert packing.packed(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans(seed):
    rng = random.Random(seed)
    lengths = [min(4096, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(20_000)] if seed else [4096] * 5 + [2049] * 7
    plan = packing.planned(Counter(lengths))
    load, ranks = Counter(), Counter()
    for length, first, count, sequence, offset in plan.places:
        assert first == ranks[length]
        ranks[length] += count
        for k in range(sequence, sequence + count):
            assert load[k] == offset
            load[k] += length
    assert ranks == Counter(lengths) and max(load.values()) <= 4096
    if seed:
        assert len(load) <= 1.01 * sum(lengths) / 4096 + 1
    else:
        assert len(load) == 12
    assert packing.planned({}).sequences == 0


def test_html_cases():
    cases = {
        "": "", "plain": "plain", "<p>a<p>b": "a\n\nb", "<div>a</div><div>b": "a\nb", "a<br>b": "a\nb", "<b>x</b> y &amp; &lt;z&gt; &eacute;": "x y & <z> é",
        "<head><title>t</title><style>p{}</style></head><body>x<script>if(a<b){}</script>y<!-- c -->": "xy", "<p hidden>a</p><p style='display: none'>b</p><p>c": "c",
        "<ul><li>a<li>b<ul><li>c</ul></ul>": "- a\n- b\n\n  - c", "<ol start=3><li>a<li value=7>b<li>c</ol>": "3. a\n7. b\n8. c", "<ol reversed><li>a<li>b</ol>": "2. a\n1. b",
        "<table><tr><th>n<th>long name<tr><td>1<td>x<td>y</table>": "n  long name\n1  x          y", "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
        "<pre>\n a\n  b</pre>": " a\n  b", "<details><summary>s</summary>hidden</details>": "s", "<details open><summary>s</summary>shown</details>": "s\nshown", "<select><option>a<option selected>b</select>": "b",
        "a  \n b": "a b", "<textarea>q</textarea><noscript>n</noscript>": "q", "<blockquote>q</blockquote>": "  q", "</p></div>x": "x", "<table><td>a<td>b": "a  b", "x<svg><text>s</text></svg>y": "xy",
    }
    for page, text in cases.items():
        assert html.rendered(page) == text, page
    assert html.rendered(None) == ""


def test_html_tables_align():
    """Every cell of a column starts at one place, whatever stands before it; no text is lost."""
    wide = "w" * 55
    page = f"<table><tr><td>a<td>b<td>c<tr><td>{wide}<td>x<td>y<tr><td>日本語<td>p<td>q<tr><td>e\u0301<td>r</table>"
    assert html.rendered(page).split("\n") == ["a" + " " * 41 + "b  c", wide, " " * 42 + "x  y", "日本語" + " " * 36 + "p  q", "e\u0301" + " " * 41 + "r"]
    assert html.rendered("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a  b\n   c\n   d"
    rng = random.Random(1)
    for _ in range(40):
        cells = [["".join(rng.choice("ab日é") for _ in range(rng.choice((1, 3, 12, 60)))) + f"{i}.{j}" for j in range(4)] for i in range(5)]
        lines = html.rendered("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in cells) + "</table>").split("\n")
        places = [{html.columns(line[: line.index(c)]) for line in lines for row in cells for k, c in enumerate(row) if k == j and c in line.split()} for j in range(4)]
        assert all(len(p) == 1 for p in places) and sum(len(line.split()) for line in lines) == 20


def test_html_visibility():
    cases = {
        "<div style='visibility:hidden'>a<p>b<p style='visibility: visible'>c</div>d": "c\n\nd", "<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>": "- b",
        "<table style='visibility:collapse'><tr><td>a<td style='visibility:visible'>b</table>": "b", "<p style='display:none'><b style='visibility:visible'>a</b>": "", "<pre style='visibility:hidden'>a</pre>x": "x",
    }
    for page, text in cases.items():
        assert html.rendered(page).strip() == text, page


def test_html_long_and_deep():
    assert html.rendered("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert html.rendered("<p>" + "word " * 100_000).count("word") == 100_000
    assert html.rendered("<ul>" + "<li>x<ul>" * 300).count("x") == 300


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (None, None, None), (1, "u", "<p>a")], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    same(html.extracted(pages).collect(), [(1, "u", "a"), (None, None, ""), (1, "u", "a")])
    assert html.extracted(pages.limit(0)).count() == 0


def test_substring(docs, rows, empty):
    ordered = sorted((r for r in rows), key=lambda r: (r[0] is None, r[0] or 0))
    got = substring.without_repeats(docs).collect()
    want = brute.without_repeats(ordered)
    once = Counter(r[0] for r in rows)
    same([r[:] for r in got if once[r["doc_id"]] == 1], [(r[0], *w) for r, w in zip(ordered, want) if once[r[0]] == 1])
    assert sum(r["n_removed"] for r in got) == sum(w[1] for w in want) > 0
    assert substring.without_repeats(empty).count() == 0


def test_substring_frequent_anchors(docs, monkeypatch):
    """Windows that are sharded one by one give what segments give."""
    whole = sorted(map(repr, substring.without_repeats(docs).collect()))
    for hot in (0, 1, 3):
        monkeypatch.setattr(substring, "HOT", hot)
        assert sorted(map(repr, substring.without_repeats(docs).collect())) == whole


def test_automaton_against_sets():
    rng = random.Random(1)
    for _ in range(60):
        a, seen = substring.Automaton(), set()
        for _ in range(5):
            words = [rng.randrange(3) for _ in range(rng.randrange(0, 30))]
            want = []
            for i in range(max(0, len(words) - 3)):
                want.append(tuple(words[i : i + 4]) in seen)
                seen.add(tuple(words[i : i + 4]))
            assert a.stream(words, 4).tolist() == want


def test_language(spark, docs, rows, empty):
    rng = random.Random(6)
    pieces = {"en": ["the", "ing", "th", "er", "and"], "fr": ["eau", "que", "ou", "é", "le"], "xx": ["zk", "vrz", "kh", "y"]}
    data = [(k, " ".join("".join(rng.choices(pieces[g], k=3)) for _ in range(30)), g, "s") for k in range(240) for g in [rng.choice(list(pieces))]]
    frame = spark.createDataFrame([*data, (900, None, "en", "s"), (901, "12 !!", "fr", "s"), (None, "the and", None, None)], DOC)
    got = {r["doc_id"]: r for r in langid.identify(frame).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= got[k]["score"] <= 1 for k, *_ in data)
    assert sum(got[k]["lang_pred"] == g for k, _, g, _ in data) >= 0.98 * len(data)
    assert [got[k][2:] for k in (900, 901)] == [("und", 0.0)] * 2
    kept = langid.identified(docs)
    assert kept.columns == docs.columns
    want = brute.languages(rows, langid.Profiles().letter)
    same([(r["doc_id"],) for r in kept.collect()], [(r[0],) for r, (_, lang, score) in zip(rows, want) if lang != "und" and (score >= langid.LEAST or len(r[1]) < langid.SURE)])
    assert 0 < sum(w[1] != "und" for w in want) - kept.count()
    judged = sorted(map(tuple, langid.identify(docs).collect()), key=repr)
    for g, w in zip(judged, sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-4)
    assert langid.identify(empty).count() == 0 and {r["lang_pred"] for r in langid.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_vectors_of_long_texts(monkeypatch):
    """Slices of a text add up to the whole, whatever their size."""
    rng = random.Random(9)
    texts = [prose(rng, 400), None, "a", "", prose(rng, 3) + " 12 " * 50]
    whole = langid.Profiles().vectors(texts)
    monkeypatch.setattr(langid, "HELD", 37)
    assert (langid.Profiles().vectors(texts) == whole).all()


def test_vectors_by_definition():
    p = langid.Profiles(dim=64)
    v = p.vectors(["Ab c", "12", None])
    assert not v[1:].any()
    want = np.zeros(64)
    for gram in (" ab", "ab ", "b c", " c "):
        want += np.prod([np.roll(p.letter(ord(c)).astype(int), k) for k, c in enumerate(gram)], axis=0)
    assert (v[0] == want).all()
