"""Operators 1, 4, 5, 9 and 10, and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from opinionlab.llm import binary_ids, link_trust, mixing, ngram_join, pieces, quality, registry, secrets, topk
from opinionlab.llm.tables import stored


def test_names(spark):
    names = [n for n in registry.queries()]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] and set(registry.oracle_sql()) <= set(names)


# ---- 1


def test_links_same_as_sql(spark, small, same):
    same(registry.queries()["op1_link_trust_url_filter"](spark, small), registry.oracle_sql()["op1_link_trust_url_filter"])


def brute_parts(edges, hosts, seeds, d, n):
    """host -> part of what it receives that comes from the seeds, by n steps over plain dictionaries."""
    total = {}
    for (a, _), w in edges.items():
        total[a] = total.get(a, 0) + w
    got = []
    for own in (seeds, hosts):
        score = {s: 1 - d for s in own}
        for _ in range(n):
            new = {s: 1 - d for s in own}
            for (a, b), w in edges.items():
                if a in score:
                    new[b] = new.get(b, 0) + d * score[a] * w / total[a]
            score = new
        got.append(score)
    return {h: 1.0 if h in seeds else got[0].get(h, 0) / (got[1][h] - (1 - d)) if got[1][h] - (1 - d) > 1e-12 else 0.0 for h in hosts}


def test_links_by_force(spark):
    rng = random.Random(5)
    hosts = [f"h{k}.org" for k in range(12)]
    pages, edges = [], {}
    for k in range(80):
        src = rng.choice(hosts)
        links = [rng.choice(hosts) for _ in range(rng.randint(0, 4))]
        for dst in links:
            if dst != src:
                edges[src, dst] = edges.get((src, dst), 0) + 1
        pages.append((k, f"https://{src}/p{k}", " ".join(f'<a href="http://{x}:80/q">x</a>' for x in links) + '<a href="/local">y</a>' + "z" * (k * 5000)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    trusted, blocked = ("h0.org", "h1.org"), ("h2.org",)
    got = {r["page_id"]: r for r in link_trust.filter_urls(df, trusted, blocked).collect()}
    # many more steps than the operator's: what it leaves out is small
    trust = brute_parts(edges, hosts, trusted, 0.85, 300)
    distrust = brute_parts({(b, a): w for (a, b), w in edges.items()}, hosts, blocked, 0.85, 300)
    exact = brute_parts(edges, hosts, trusted, 0.85, link_trust.steps())
    for k, url, _ in pages:
        h = url.split("/")[2]
        a, b = trust[h], distrust[h]
        assert abs(got[k]["trust"] - a) < 0.01 and abs(got[k]["distrust"] - b) < 0.01 and abs(got[k]["trust"] - exact[h]) < 2e-6
        assert got[k]["kept"] == (h not in blocked and not (got[k]["distrust"] >= 0.5 and got[k]["distrust"] > got[k]["trust"]))


def test_links_block_however_many(spark):
    pages = [(k, f"https://h{k}.org/", '<a href="https://bad.org/">x</a>') for k in range(500)] + [(500, "https://fine.org/", '<a href="https://good.org/">x</a>')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in link_trust.filter_urls(df, ("good.org",), ("bad.org",)).collect()}
    assert [k for k, r in got.items() if r["kept"]] == [500] and all(got[k]["distrust"] == 1 for k in range(500))


def test_hosts(spark):
    want = {
        "http://foo_bar.example.com/x": "foo_bar.example.com", "http://exämple.com/": "exämple.com", "https://u:p@A.Example.COM:8080?x": "a.example.com", "//x.org": "x.org", "http://[2001:DB8::1]:80/y": "[2001:db8::1]",
        "http://a.org#b": "a.org", "http://a b.org/": None, "http://a.org%00/": None, "http://a<b/": None, "ftp://a.org/": None, "http:///x": None, "http://...": None, "": None, "http://x.org\\y": "x.org",
    }
    got = {r["u"]: r["h"] for r in spark.createDataFrame([(u,) for u in want], "u string").select("u", link_trust.host(F.col("u")).alias("h")).collect()}
    assert got == want


def test_site_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c.example.com/", ""), (2, "http://www.foo.com/", ""), (3, "http://www.com/", ""), (4, "http://x.foo.com", "")], "page_id long, url string, html string")
    got = {(r["src"], r["dst"]) for r in link_trust.host_edges(pages).collect()}
    up = {("a.b.c.example.com", "b.c.example.com"), ("b.c.example.com", "c.example.com"), ("www.foo.com", "foo.com")}
    assert got == up | {(b, a) for a, b in up}


def test_links_odd_rows(spark):
    rows = [(None, None, None), (1, None, "<a href='http://x.org'>"), (2, "not a url", "x"), (3, "HTTP://u@A.example.COM:8080/x", None), (4, "https://cheap-pills.example.com", ""), (4, "https://cheap-pills.example.com", ""), (5, "//www.cheap-pills.example.com/y", '<a href=//cheap-pills.example.com>z')]
    df = spark.createDataFrame([(*r, "t", "s") for r in rows], "page_id long, url string, html string, trust string, host string")
    got = link_trust.filter_urls(df, registry.TRUSTED, registry.BLOCKED).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["host"] is None and not by[1]["kept"] and not by[2]["kept"] and by[3]["host"] == "a.example.com" and by[3]["kept"] and not by[4]["kept"] and not by[5]["kept"]
    assert link_trust.filter_urls(df.limit(0), registry.TRUSTED, registry.BLOCKED).count() == 0 and link_trust.filter_urls(df, (), ()).filter("trust > 0 OR distrust > 0").count() == 0


# ---- 4


@given(st.dictionaries(st.integers(1, 25), st.integers(1, 5), min_size=1, max_size=7), st.floats(0, 1.1))
@settings(max_examples=150, deadline=None)
def test_fit_by_force(counts, part):
    lengths, n = np.array(list(counts)), np.array(list(counts.values()))
    budget = int(part * (lengths * n).sum())
    took = mixing.fit_lengths(lengths, n, budget)
    reach = {0}
    for a, c in counts.items():
        reach = {x + a * k for x in reach for k in range(c + 1)}
    assert ((took >= 0) & (took <= n)).all() and (lengths * took).sum() == max(x for x in reach if x <= budget)


def test_fit_large():
    rng = np.random.default_rng(2)
    lengths = np.unique(rng.integers(1, 30_000, 4000))
    counts = rng.integers(1, 40, len(lengths))
    total, least = int((lengths * counts).sum()), int(lengths[0])
    for budget in (0, least, 10**6, total // 3, total - least, total, total + 5):
        assert (lengths * mixing.fit_lengths(lengths, counts, budget)).sum() == min(budget, total)
    assert (lengths * mixing.fit_lengths(lengths, counts, total - 1)).sum() == total - least


def test_mix_meets_weights(docs):
    weights = {f"src{k}": 1.0 + k % 3 for k in range(10)} | {"absent": 5.0, "src11": 0.0}
    rows = mixing.mix(docs, weights).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["n_tokens"] == len(texts[r["doc_id"]].split()) for r in rows)
    have, took = {}, {}
    for r in docs.collect():
        have[r["source"]] = have.get(r["source"], 0) + len(r["text"].split())
    for r in rows:
        took[r["source"]] = took.get(r["source"], 0) + r["n_tokens"]
    own = {s: w for s, w in weights.items() if w > 0 and s in have}
    budget = min(have[s] * sum(own.values()) / w for s, w in own.items())
    for s, w in own.items():  # the largest sum that any choice gives, as bits
        aim, reach = min(have[s], int(int(budget) * (w / sum(own.values())))), 1
        for r in docs.filter(f"source = '{s}'").collect():
            reach |= reach << len(r["text"].split())
        assert took.get(s, 0) == (reach & ((1 << (aim + 1)) - 1)).bit_length() - 1
    assert set(took) <= set(own)
    again = mixing.mix(docs.repartition(5), weights).collect()
    assert {r["doc_id"] for r in again} == {r["doc_id"] for r in rows}
    assert {r["doc_id"] for r in mixing.mix(docs, weights, broadcast_rows=0).collect()} == {r["doc_id"] for r in rows}
    fixed = mixing.mix(docs, weights, budget=3000)
    assert sum(r["n_tokens"] for r in fixed.collect()) <= 3000


def test_mix_takes_the_least_hashes(spark):
    """Brute force over equal lengths: the seeded order decides."""
    df = spark.createDataFrame([(k, f"w{k} x y", "src0") for k in range(50)] + [(100, "a b c", "src1")] * 5, "doc_id long, text string, source string")
    got = {r["doc_id"] for r in mixing.mix(df, {"src0": 1.0}, budget=30).collect()}
    order = [r["doc_id"] for r in df.filter("source = 'src0'").orderBy(F.xxhash64(F.lit(11), "doc_id", "text")).collect()]
    assert got == set(order[:10]) != {r["doc_id"] for r in mixing.mix(df, {"src0": 1.0}, budget=30, seed=12).collect()}
    assert mixing.mix(df, {"src1": 1.0}, budget=9).count() == 0 and mixing.mix(df, {"src1": 1.0}, budget=15).count() == 5  # repeated rows go together


def test_mix_odd_rows(odd, none):
    rows = mixing.mix_rows(odd, {f"src{k}": 1.0 for k in range(8)}, budget=10_000_000)
    assert rows.columns == odd.columns
    assert {r["doc_id"] for r in rows.collect()} == {None, 3, 4, 5, 6, 7, 8, 10} and mixing.mix(none).count() == 0 and mixing.mix(odd, {}).count() == 0
    assert mixing.mix(odd, {"src1": 1.0, "absent": 1.0}, require_all=True).count() == 0


def test_tokens_counted(spark):
    texts = [None, "", " ", "a", " a  b\n\tc ", "é　x y", "\r\nz"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    want = [0 if t is None else sum(1 for w in t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w) for t in texts]
    assert [r[1] for r in sorted(df.select("k", mixing.n_tokens(df["t"])).collect())] == want


def test_mix_counts_once(docs):
    """A filter or join by the number of tokens doesn't count again in a second Python worker of the task."""
    weights = {f"src{k}": 1.0 for k in range(10)}
    for df in (mixing.mix_rows(docs, weights), mixing.mix(docs, weights, broadcast_rows=0), docs.select(mixing.n_tokens(docs["text"]).alias("n")).filter("n > 0")):
        assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ArrowEvalPython") == 1


# ---- 5


def brute_top(ids, v, k):
    products = np.round(v @ v.T, 6) + 0.0
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-products[i, j], ids[j]))[:k]
        out |= {(int(ids[i]), r + 1, int(ids[j])) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("kind", ["lengths", "clusters", "ties"])
def test_top_k_by_force(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8))
    if kind == "lengths":
        v *= rng.lognormal(0, 1.5, (400, 1))
    elif kind == "clusters":
        v = np.repeat(rng.normal(size=(20, 8)), 20, 0) + rng.normal(size=(400, 8)) * 0.02
    else:
        v = rng.integers(-1, 2, (400, 8)).astype(float)
    ids = rng.permutation(400)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["rank"], r["neighbour_id"]) for r in topk.top_k(df, 5, every=1, bucket=64, block=50).collect()}
    want = brute_top(ids, v, 5)
    assert got == want
    assert {(r["vec_id"], r["rank"], r["neighbour_id"]) for r in topk.top_k(df, 5, every=7, bucket=64, block=50).collect()} == {x for x in want if x[0] % 7 == 0}
    met, blocks, buckets = topk.pairs(df, 5, 1, 48, 10).count(), topk._packed(topk.clean(df), 10).count(), topk._packed(topk.clean(df), 48).count()
    assert met < 0.8 * blocks * buckets if kind == "lengths" else met <= blocks * buckets


def test_top_k_same_as_sql(spark, small, same):
    same(registry.queries()["op5_exact_top_k"](spark, small), registry.oracle_sql()["op5_exact_top_k"])


def test_top_k_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [2.0, 1.0]), (9, [2.0, 1.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, rank string, norm int")
    got = sorted(tuple(r) for r in topk.top_k(df, 2, every=1).collect())
    assert got == [(1, 1, 9, 2.0), (1, 2, 2, 0.0), (2, 1, 1, 0.0), (2, 2, 9, 0.0), (9, 1, 1, 2.0), (9, 2, 2, 0.0), (10, 1, 2, 0.0), (10, 2, 1, -1.0)]
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.filter("vec_id = 1")).count() == 0


def test_coordinate_pruning_is_exact():
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(30, 6)), 10, 0) + rng.normal(size=(300, 6)) * 0.01
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = np.arange(300)
    theta = np.full(300, 0.95)
    found = {(q, i) for q, own, _ in topk.search(ids, v, theta, topk.Bucket(ids, v), 300) for i in own.tolist()}
    want = {(i, j) for i in range(300) for j in range(300) if i != j and round(float(v[i] @ v[j]), 6) >= 0.95}
    assert found == want


# ---- 9


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=8))
@settings(max_examples=200, deadline=None)
def test_coding_round_trip(runs):
    values = np.array([x for r in runs for x in r], np.uint32)
    control, data = binary_ids.compress(values, np.array([len(r) for r in runs], np.int64))
    for r, c, d in zip(runs, control, data, strict=True):
        assert binary_ids.expand(c, d, len(r)).tolist() == r and len(c) == (len(r) + 3) // 4
        assert len(d) == sum(max(1, (x.bit_length() + 7) // 8) for x in r)


def test_binary_round_trip(docs, odd, none):
    for df in (docs, odd):
        coded, table = binary_ids.write_binary(df)
        back = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"] is None, r["ids"] or []) for r in binary_ids.read_binary(coded, table).collect())
        assert back == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"] is None, r["ids"] or []) for r in pieces.encode(df).collect())
        counts = [r["n"] for r in table.orderBy("rank").collect()]
        from collections import Counter

        brute = Counter(i for x in back for i in x[3])
        assert [(r["rank"], r["id"], r["n"]) for r in table.orderBy("rank").collect()] == [(k, i, n) for k, (i, n) in enumerate(sorted(brute.items(), key=lambda x: (-x[1], x[0])))]
        assert counts == sorted(counts, reverse=True) and sum(counts) == sum(len(x[3]) for x in back)
    coded, table = binary_ids.write_binary(none)
    assert coded.count() == 0 and table.count() == 0


def test_coding_memory():
    rng = np.random.default_rng(10)
    sizes = rng.integers(0, 2000, 500)
    values = (2.0 ** rng.uniform(0, 32, sizes.sum())).astype(np.uint32)
    (control, by_control, data, by_data), most = _most(binary_ids._coded, values, sizes)
    assert most < 6 * values.nbytes
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for k, n in enumerate(sizes.tolist()):
        assert (binary_ids.expand(control[by_control[k] : by_control[k + 1]].tobytes(), data[by_data[k] : by_data[k + 1]].tobytes(), n) == values[ends[k] : ends[k + 1]]).all()


# ---- 10

ODD_TEXTS = ["", " ", "  ", " a  b\nc  ", "x　y ﬁ ①\tz", "éanment x", "\n\n a", "日本語 テキスト😀😀 ok", "a\n b\n\nc ", "def f(x):\n    return x*2  # ok\n" * 5, "a" * 3000, "x​q", "▁", "a ▁ b"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def ids_of(own, text):
    return np.frombuffer(own.encode(text), np.int32).tolist()


def test_pieces_same_as_library(library, docs):
    own = pieces.encoder(pieces.MODEL)
    rng = random.Random(6)
    letters = list("abcdefgh étionthe\nß  12.,日😀")
    texts = ODD_TEXTS + [r["text"] for r in docs.select("text").collect()] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    assert [ids_of(own, t) for t in texts] == library.encode(texts)
    ids, bounds = own.encode_batch(pa.array([None, *texts]))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[], *library.encode(texts)]
    assert own.same(pa.array([None, *texts]), ids, bounds).tolist()[1:] == [library.decode(x) == t for x, t in zip(library.encode(texts), texts, strict=True)]
    assert all(own.decode(ids_of(own, t)) == library.decode(library.encode(t)) for t in texts)


def test_neighbours_by_merging():
    own = pieces.encoder(pieces.MODEL)
    rng, usual = random.Random(8), [i for p, i in own.ids.items() if len(p) < 9]
    ends = {k: [i for i in usual if own.pieces[i][0] == k] for k in "aetnos"}
    for _ in range(8000):
        left = rng.choice(usual)
        right = rng.choice(ends[rng.choice("aetnos")])
        assert own.neighbours(left, right) == (own.merged(own.pieces[left] + own.pieces[right]) == [left, right])
    assert all(own.neighbours(own.unknown, i) == (own.merged(own.pieces[i]) == [i]) for i in usual[:3000])


def _unigram(scores, text):
    """The best sum over every segmentation, by plain recursion over positions."""
    best = [0.0] + [-np.inf] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(e):
            if text[s:e] in scores:
                best[e] = max(best[e], best[s] + scores[text[s:e]])
    return best[-1]


def test_unigram_by_force():
    data = open(pieces.MODEL, "rb").read()
    at = data.rindex(b"\x18\x02 \x80\xfa\x01")  # the trainer's model type
    own = pieces.Encoder(data[:at] + b"\x18\x01" + data[at + 2 :])
    assert own.mode == pieces.UNIGRAM
    scores = {p: own.scores[i] for p, i in own.ids.items()}
    rng = random.Random(7)
    for _ in range(400):
        text = pieces.SPACE + "".join(rng.choice("thenationer") for _ in range(rng.randint(1, 14)))
        ids = own.segment(text)
        assert "".join(own.pieces[i] for i in ids) == text and sum(own.scores[i] for i in ids) == _unigram(scores, text)
        flat, bounds = own.encode_batch(pa.array([text[1:], text[1:3]]))
        assert flat[: bounds[1]].tolist() == ids and bounds[1] < len(flat)


def test_pieces_odd_rows(odd, docs, none):
    got = pieces.encode(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r["ids"] is None) == (r["round_trip"] is None) and r["n_ids"] == len(r["ids"] or [])
    assert all(r["round_trip"] in (True, None) for r in got)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs)).collect()} == texts
    assert pieces.encode(none).count() == 0 and pieces.decode(pieces.encode(none)).count() == 0


def test_remembering_has_an_end(monkeypatch, library):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    own = pieces.Encoder(open(pieces.MODEL, "rb").read())
    texts = [f"number {k} of manythings{k * k}" for k in range(300)]
    assert [ids_of(own, t) for t in texts] == library.encode(texts) and len(own.words) <= 50 and len(own.agreed) <= 50


def _most(f, *args):
    """The result, and the bytes of arrays and Python objects held at most."""
    import tracemalloc

    tracemalloc.start()
    try:
        return f(*args), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_pieces_memory_of_a_batch():
    own = pieces.encoder(pieces.MODEL)
    rng = random.Random(9)
    words = ["".join(rng.choice("thenationer,") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts = pa.array([" ".join(rng.choices(words, k=500)) for _ in range(pieces.BATCH // 3000)])
    own.encode_batch(texts[:3])
    (ids, bounds), most = _most(own.encode_batch, texts)
    assert most < 8 * texts.nbytes
    same, most = _most(own.same, texts, ids, bounds)
    assert most < 3 * texts.nbytes and same.all()
    other = pa.array([t[:-1] + ("x" if t[-1] != "x" else "y") if k % 3 == 0 else t + "x" if k % 3 == 1 else t for k, t in enumerate(texts.to_pylist())])
    assert own.same(other, ids, bounds).tolist() == [k % 3 == 2 for k in range(len(texts))]


# ---- the pipeline


def test_pipeline_by_force(spark, small, docs, labels, library, tmp_path):
    """Each stage against a plain version on what its predecessor kept."""
    columns = docs.columns
    at = docs
    kept = {r["doc_id"] for r in quality.quality_scores(docs, labels).collect() if r["kept"]}
    at = stored(corpus_pipeline.STAGES[0][1](spark, at, small))
    assert at.columns == columns and {r["doc_id"] for r in at.collect()} == kept
    from test_text_operators import brute_classes

    root = {i for i, c, _ in brute_classes([(r["doc_id"], r["text"]) for r in at.collect()]) if i == c}
    at = stored(corpus_pipeline.STAGES[1][1](spark, at, small))
    assert at.columns == columns and {r["doc_id"] for r in at.collect()} == root
    before = {r["doc_id"]: r for r in at.collect()}
    at = stored(corpus_pipeline.STAGES[2][1](spark, at, small))
    after = {r["doc_id"]: r for r in at.collect()}
    assert at.columns == columns and after.keys() == before.keys()
    known = secrets.identifiers(spark.createDataFrame([(r["text"],) for r in before.values()], "text string"))
    for i, r in after.items():
        found = secrets.scan(before[i]["text"], dictionary=known)
        text = before[i]["text"]
        for a, b, _, _ in reversed(found):
            text = text[:a] + "[SECRET]" + text[b:]
        assert r["text"] == text and r["n_chars"] == len(text)
    mixed = {r["doc_id"] for r in mixing.mix(at).collect()}
    at = stored(corpus_pipeline.STAGES[3][1](spark, at, small))
    assert at.columns == columns and {r["doc_id"] for r in at.collect()} == mixed and 0 < len(mixed) < len(after)
    final = {r["doc_id"]: r["ids"] for r in corpus_pipeline.STAGES[4][1](spark, at, small).collect()}
    assert final == {r["doc_id"]: library.encode(r["text"]) for r in at.collect()}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, small).collect()} == final


def test_pipeline_odd_rows(spark, small, odd):
    for df in (odd, odd.limit(0)):
        at = df
        for name, stage in corpus_pipeline.STAGES:
            at = stored(stage(spark, at, small))
            assert name == corpus_pipeline.STAGES[-1][0] or at.columns == odd.columns
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert ngram_join.T == 0.5
