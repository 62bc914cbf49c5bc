"""Near-duplicates, sharding, mixing, neighbours, HTML and the pipeline: against brute force and the laws they state."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from loomwork.llm import ann, common, html, mixing, neardup, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows], DOCS)


# --- near-duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))], [len(s) for s in sets]


def near_rows(rng):
    """Groups of edits around a base, chains in which only neighbours are linked, exact copies, and odd texts."""
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))
    rows, n = [], iter(range(10_000))
    for g in range(6):
        base = [word() for _ in range(120)]
        rows.append((next(n), " ".join(base)))
        for _ in range(12):
            w = list(base)
            for _ in range(int(rng.integers(1, 4))):
                w[int(rng.integers(0, len(w)))] = word()
            rows.append((next(n), " ".join(w)))
    chain = [word() for _ in range(200)]
    for k in range(10):  # each step moves the window on, so only close ones are linked
        rows.append((next(n), " ".join(chain[8 * k : 8 * k + 120])))
    rows += [(next(n), "Same  text\nhere"), (next(n), "same text HERE"), (next(n), ""), (next(n), None), (next(n), " \t\n"), (next(n), "one"), (next(n), "é É"), (next(n), "é é")]
    rows += [(next(n), "long " * 30_000)] * 2
    return [(i, t, "en", "s") for i, t in rows]


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows(np.random.default_rng(8))
    want, sizes = brute_components(rows)
    out = neardup.near_duplicates(documents(spark, rows)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    for (d, t, *_), c, n in zip(rows, want, sizes):
        assert (got[d].component_id, got[d].n_shingles, got[d].kept) == (c, n, c == d), (d, t and t[:50])


def test_near_duplicates_without_hubs(spark, monkeypatch):
    """What hubs leave open is found in blocks, however small these are."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rows = near_rows(np.random.default_rng(9))[:60]
    want, _ = brute_components(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert [got[d] for d, *_ in rows] == want
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_near_duplicates_null_id(spark):
    out = neardup.near_duplicates(documents(spark, [(None, "a b c", None, None), (4, "a b c", None, None), (None, None, None, None)])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in out), key=str) == sorted([(None, 4, False), (4, 4, True), (None, None, True)], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


# --- sharding


def test_sharding_law(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "x" * int(rng.integers(0, 300)), "en", "s") for i in range(1500)] + [(2000 + i, "hot group of equal texts", "en", "s") for i in range(800)]
    rows += [(None, None, None, None), (9000, "", "en", "s"), (9000, "", "en", "s"), (9001, "é" * 4000, "en", "s")]
    out = sharding.shard(documents(spark, rows), sampled=8).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    total, by = sum(r.size for r in out), defaultdict(list)
    for r in out:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert sorted(by) == list(range(24))
    for some in by.values():
        assert sorted(r.slot for r in some) == list(range(len(some)))
        assert abs(sum(r.size for r in some) - total / 24) <= max(r.size for r in out)
    cut = Counter(s for s, n in ((t, len({r.shard for r in out if r.text_crc32 == t})) for t in {r.text_crc32 for r in out}) if n > 1)
    assert len(cut) <= 23


def test_splitters_do_not_change_the_result(spark):
    rows = [(i, f"t{i % 60}", "en", "s") for i in range(400)]
    first, second = ({(r.doc_id, r.shard, r.slot) for r in sharding.shard(documents(spark, rows), shards=5, sampled=k).collect()} for k in (2, 50))
    assert first == second
    assert sharding.shard(documents(spark, [])).count() == 0


# --- mixing


def brute_rake(cells, flatten, sweeps=200):
    total = sum(cells.values())
    goals = []
    for d in range(3):
        own = Counter()
        for k, v in cells.items():
            own[k[d]] += v
        raw = {k: (v / total) ** flatten for k, v in own.items()}
        goals.append({k: v / sum(raw.values()) * total for k, v in raw.items()})
    w = {k: float(v) for k, v in cells.items()}
    for _ in range(sweeps):
        for d in range(3):
            own = Counter()
            for k, v in w.items():
                own[k[d]] += v
            w = {k: v * goals[d][k[d]] / own[k[d]] if own[k[d]] else 0.0 for k, v in w.items()}
    return w


def mixed_rows():
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))) + (" !!" if rng.random() < 0.2 else ""), str(rng.choice(["en", "fr", "de"], p=[0.7, 0.2, 0.1])), "hot" if rng.random() < 0.4 else f"s{int(rng.integers(0, 5))}") for i in range(900)]
    return rows + [(1000, None, None, None), (1001, "", "en", None), (1002, "a b", None, "hot"), (5, rows[5][1], rows[5][2], rows[5][3])]


@pytest.mark.parametrize("small", [True, False])
def test_mixing_against_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(mixing, "SMALL", 0)
    rows = mixed_rows()
    out = mixing.mix(documents(spark, rows).selectExpr("*", "1 topic", "2 weight", "3 probability")).collect()
    assert len(out) == len(rows)
    cells = Counter()
    for r in out:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    assert all(r.n_tokens == len((dict((d, t) for d, t, *_ in rows)[r.doc_id] or "").split()) for r in out)
    want = brute_rake(cells, mixing.FLATTEN)
    ratio = {k: want[k] / v if v else 0.0 for k, v in cells.items()}
    top = max(ratio.values())
    for r in out:
        k = r.source, r.lang, r.topic
        assert r.weight == pytest.approx(ratio[k], abs=1e-4) and r.probability == pytest.approx(ratio[k] / top, abs=1e-4)
        assert not (r.probability == 0 and r.selected)
    drawn = sum(r.selected for r in out)
    assert abs(drawn - sum(r.probability for r in out)) < 5 * np.sqrt(sum(r.probability * (1 - r.probability) for r in out)) + 1
    assert len({r.selected for r in out if r.doc_id == 5}) == 1


def test_mixing_given_targets(spark):
    docs = documents(spark, [(i, "a b c d", "en" if i % 3 else "fr", "x" if i % 4 else "y") for i in range(120)])
    goal = spark.createDataFrame([("x", 0.25), ("y", 0.75)], "value string, share double")
    out = mixing.mix(docs, targets={"source": goal}).collect()
    w = Counter()
    for r in out:
        w[r.source] += r.weight * r.n_tokens
    assert w["y"] / sum(w.values()) == pytest.approx(0.75, abs=1e-4)
    assert mixing.mix(documents(spark, [])).count() == 0


# --- neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 16))
    x[100:400] = x[7]  # one vector is a tenth of all
    rows = [(i, v.tolist(), 0, 0.5) for i, v in enumerate(x)]
    rows += [(3000, None, 0, 0.5), (3001, [0.0] * 16, 0, 0.5), (3002, [None] * 16, 0, 0.5), (3003, [float("nan")] * 16, 0, 0.5), (3004, [], 0, 0.5), (None, [1.0] * 16, 0, 0.5), (3005, [1.0, 2.0], 0, 0.5), (3006, [2.0, 4.0], 0, 0.5), (9, x[9].tolist(), 0, 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double")
    out = ann.nearest(df, df.where("vec_id % 50 = 0 or vec_id >= 3000"))
    got = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    norms = np.sqrt((x * x).sum(1))
    hits = 0
    for q in range(0, 3000, 50):
        s = (x * x[q]).sum(1) / (norms * norms[q])
        s[q] = -9
        top = np.lexsort((np.arange(3000), -s))[:5]
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        hits += len({v for _, v, _ in got[q]} & set(top.tolist()))
        assert all(abs(s[v] - c) < 1e-12 for _, v, c in got[q])
    assert hits >= 0.9 * 5 * 60
    assert [v for _, v, _ in got[100]] == [7, 101, 102, 103, 104]  # ties to the smaller id
    assert [v for _, v, _ in got[3005]] == [3006] and set(got) == {*range(0, 3000, 50), 3005, 3006}
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert ann.chi_square_quantile(0.98, 10) == pytest.approx(21.161, abs=1e-3)


# --- HTML

PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav><div class='ad'>Buy</div>{extra}<article><header><h1>T &amp; {i}</h1></header><p>One {i}<br>line<p>Two  <b>bold</b> &eacute;{i}<ul><li>a{i}<li>b{i}</ul><table><tr><td>c{i}<td>d</table></article><aside>side</aside><section id=comments><p>nice!</section><form>f</form><footer>&copy;</footer><script>var x='</p>';</script></body></html>"


def test_html_extraction(spark):
    text = lambda i: f"T & {i} One {i} line Two bold é{i} a{i} b{i} c{i} d"
    rows = [(i, f"https://Site.example:80/{i}", PAGE.replace("{extra}", "<div>Follow us for more</div>").replace("{i}", str(i))) for i in range(12)]
    rows += [(50, "http://other.example/", PAGE.replace("{extra}", "<div>Read on</div>").replace("{i}", "9")), (51, None, None), (52, "x", ""), (53, "http://deep.example", "<div>" * 20_000 + "deep"), (54, "http://odd.example", "a < b <p>c & d<!-- no --><p hidden>no</p>"), (3, "https://site.example/3", rows[3][2])]
    df = spark.createDataFrame([(*r, "text", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = html.extract(df)
    got = {r.page_id: r for r in out.collect()}
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == len(rows)
    assert all(got[i].text == text(i) for i in range(12)), got[0].text  # the line that all pages of the host share is gone
    assert got[50].text == "Read on " + text(9)
    assert got[51].text == got[52].text == "" and got[51].n_chars == 0
    assert got[53].text == "deep" and got[54].text == "a < b c & d"
    assert html.extract(df.where("false")).count() == 0


# --- the pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = np.random.default_rng(12)
    calm = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(240):
        words = list(rng.choice(calm, 60))
        if i % 6 == 0:
            words[int(rng.integers(0, 60))] = "zonker"
        rows.append((i, " ".join(words) + ".", "en" if i % 3 else "fr", f"s{i % 4}"))
        marks.append((i, 1, int(i % 6 == 0)))
    rows += [(300 + i, rows[1][1], "en", "s1") for i in range(5)] + [(310, "key token = abcdefgh12345678 end of it", "en", "s0"), (311, None, None, None), (310, "key token = abcdefgh12345678 end of it", "en", "s0")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash", "secrets", "mixing", "bpe"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, docs, str(tmp_path)))
        if name != "bpe":
            assert after.columns == docs.columns
        seen[name] = (docs, after)
        docs = after
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    kept = ids(seen["toxicity"][1])
    assert not any(d % 6 == 0 and d < 240 for d in kept if d is not None) and sum(kept.values()) == len(rows) - 40
    alone = ids(seen["minhash"][1])
    assert alone[1] == 1 and not any(alone[300 + i] for i in range(5)) and alone[310] == 1 and sum(alone.values()) == 202
    assert ids(seen["secrets"][1]) == alone
    assert {r.text for r in seen["secrets"][1].where("doc_id = 310").collect()} == {"key [SECRET] end of it"}
    assert 0 < sum(ids(seen["mixing"][1]).values()) < 202
    assert ids(seen["bpe"][1]) == ids(seen["mixing"][1])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert ids(whole) == ids(seen["bpe"][1])
