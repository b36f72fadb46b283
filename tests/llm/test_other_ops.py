"""Archives, nearest neighbours, and the pipeline against a brute-force version."""

from __future__ import annotations

import hashlib
import io
import random
import re
from collections import Counter

import numpy as np
import pytest


def test_arc_versions():
    from lexiloom.llm import warc as W

    for version in (1, 2):
        data = W.arc_start(version, "x.arc") + W.arc_record(version, "http://a/b c", "1.2.3.4", "19970203", "text/html", b"HTTP/1.0 200 OK\nA: b\n\nbody\n") + W.arc_record(version, "dns:a", "1.2.3.4", "19970203040506", "text/dns", b"19970203\na 1 IN A 1.2.3.4\n")
        records = list(W.read_arc(io.BytesIO(data)))
        assert [r.version for r in records] == [version] * 3 and records[1].payload == b"body\n" and records[1].fields["url"] == "http://a/b%20c"
        out = list(W.read_warc(io.BytesIO(b"".join(W.convert(r, "x.arc") for r in records))))
        assert [h["warc-type"] for h, _ in out] == ["warcinfo", "response", "response"]
        assert out[1][0]["warc-date"] == "1997-02-03T00:00:00Z" and out[1][0]["warc-payload-digest"] == W.digest32(b"body\n")
        assert len({h["warc-record-id"] for h, _ in out}) == 3
        with pytest.raises(ValueError):
            list(W.read_arc(io.BytesIO(data[:-10])))
    with pytest.raises(ValueError):
        list(W.read_arc(io.BytesIO(b"no archive\n")))


def test_headers_of_old_servers_and_payloads_with_empty_lines():
    from lexiloom.llm import warc as W

    for gap in (b"\r\n\r\n", b"\n\n"):
        for payload in (b"", b"hello\r\n\r\nworld", b"a\n\nb"):
            content = b"HTTP/1.0 200 OK" + gap[: len(gap) // 2] + b"X-Page-Id: 7" + gap + payload
            r = next(x for x in W.read_arc(io.BytesIO(W.arc_start(1, "x.arc") + W.arc_record(1, "u", "0.0.0.0", "1999", "text/html", content))) if x.ordinal)
            assert r.payload == payload and W.http_header(content, "x-page-id") == "7"
            (headers, block) = next(iter(W.read_warc(io.BytesIO(W.convert(r, "x.arc")))))
            assert W.split_http(block)[1] == payload and headers["warc-payload-digest"] == W.digest32(payload)


def test_a_malformed_archive_is_converted_up_to_the_fault(spark, tmp_path):
    from lexiloom.llm import warc as W

    page = lambda i: W.arc_record(1, f"http://a/{i}", "0.0.0.0", "1999", "text/html", b"HTTP/1.0 200 OK\nX-Page-Id: %d\n\nbody" % i)
    parts = {"good": W.arc_start(1, "x") + page(1) + page(2), "short": W.arc_start(1, "x") + page(3) + page(4)[:-9], "wrong": W.arc_start(1, "x") + page(5) + page(6).replace(b" 34\n", b" 32\n", 1) + page(7), "none": b"<html>"}
    assert b" 34\n" in page(6)
    for name, data in parts.items():
        (tmp_path / f"{name}.arc").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / f"{n}.arc"),) for n in parts], "path string")
    assert sorted(r["page_id"] for r in W.index_arcs(files).collect()) == [1, 2, 3, 5, 6]
    warcs = W.convert_arcs(files, str(tmp_path / "out"))
    assert sorted((r["path"].rsplit("/", 1)[1].split("-")[0], r["fault"] is None) for r in warcs.collect()) == [("good", True), ("none", False), ("short", False), ("wrong", False)]
    assert sorted(r["page_id"] for r in W.read_warcs(warcs).collect()) == [1, 2, 3, 5, 6]


def test_archive_pages(spark):
    from lexiloom.llm.warc import archive_pages

    big = "é" * 600
    rows = [(1, "http://a", big), (2, "http://b c", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", "y" * 200_000), (3, None, big), (None, "u", "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as path", "'clash' as sha1").repartition(3)
    got = sorted((tuple(r) for r in archive_pages(pages).collect()), key=repr)
    want, seen = [], 0
    for i, _, h in rows:
        payload = (h or "").encode()
        again = h == big and (i != 3 or seen)
        seen += i == 3
        want.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=repr)
    assert archive_pages(pages.where("false")).count() == 0


def test_nearest_neighbours(spark, monkeypatch):
    from lexiloom.llm import ann

    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 24)).astype(np.float32) * rng.uniform(0.2, 3, (700, 1)).astype(np.float32)
    x[100:300] = x[100]  # one vector for many ids: ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [1.0, None] * 12), (1004, [float("inf")] * 24), (1005, []), (None, [1.0] * 24), (1020, [1.0, 2.0]), (5, x[5].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'clash' as id", "'clash' as score")
    monkeypatch.setattr(ann, "INDEX_BYTES", 128 * 24 * 8)
    monkeypatch.setattr(ann, "QUERY_BYTES", 16 * 24 * 8)
    got = {}
    for r in ann.search(table, table.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    d, hit = x.astype(np.float64), 0
    assert set(got) == set(range(0, 700, 20))  # 1020 has no candidate of its own dimension
    for q, found in got.items():
        score = (d * d[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(700), -score)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - score[f[1]]) < 1e-12 for f in found)
        hit += len({f[1] for f in found} & set(best))
    assert hit >= 0.9 * 20 * len(got)
    assert ann.search(table.where("false"), table).count() == 0


def test_registered_ann_query_recalls_its_neighbours(spark):
    """Recall of op1_ann against brute force at sf0.01, all of its queries."""
    from lexiloom.llm.ann import op1_ann

    table = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{table}/embeddings.parquet").collect() if r["embedding"]]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = {}
    for r in op1_ann(spark, table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = n = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(got[ids[q]] & set(ids[np.argsort(-score)[:20]].tolist()))
        n += 20
    assert hit >= 0.9 * n


def _pipeline_by_brute_force(spark, data):
    """The documents that the mix takes, as (doc_id, times), and what each stage before has left: plain definitions over all pairs."""
    import duckdb
    import pandas as pd

    from lexiloom.llm import decontaminate, quality
    from lexiloom.llm.mixing import OP5_SQL
    from tests.llm.test_text_ops import components

    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    held = {r["doc_id"]: r for r in docs.collect()}
    good = sorted(r["doc_id"] for r in quality.scores(docs, model).collect() if r["score"] >= 0.3)

    def shingles(i):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), held[i]["text"] or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    own = {i: shingles(i) for i in good}
    root = components(good, lambda a, b: 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]))
    one = [i for i in good if root[i] == i]
    plain = lambda t: [x for x in map(decontaminate.plain, re.findall(r"[^\x20\x09-\x0D]+", t or "")) if x]
    code: dict[str, int] = {}
    coded = lambda t: np.array([code.setdefault(x, len(code)) for x in plain(t)], np.uint64)
    items = [coded(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = []
    for i in one:
        w = coded(held[i]["text"])
        grams = lambda v: {tuple(v[k : k + 3].tolist()) for k in range(len(v) - 2)}
        mine = grams(w)
        leak = any(len(x) > 2 and mine & grams(x) and decontaminate.smith_waterman(x, w)[0] >= 0.5 * 2 * len(x) for x in items)
        clean += [] if leak else [i]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, held[i]["text"], held[i]["source"]) for i in clean], columns=["doc_id", "text", "source"]))
    times = {i: (n // size if size else None) for i, size, n in con.execute(f"SELECT doc_id, size, taken FROM ({OP5_SQL})").fetchall()}
    return held, good, one, clean, times


def test_pipeline_against_brute_force(spark, data):
    """Every stage and the rows of run() against plain definitions over all documents; only the model's scores are taken as they are."""
    import zlib

    import corpus_pipeline
    from lexiloom.llm import tokens

    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    held, good, one, clean, times = _pipeline_by_brute_force(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], (good, one, clean), strict=True):
        docs = stage(spark, docs, data)
        assert sorted(r["doc_id"] for r in docs.collect()) == want and docs.columns == spark.read.parquet(f"{data}/documents.parquet").columns
    out = sorted(corpus_pipeline.run(spark, data).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in out] == np.cumsum([0, *[r["n_tokens"] for r in out][:-1]]).tolist()
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)
    assert {i: n for i, n in Counter(r["doc_id"] for r in out).items() if times[i] is not None} == {i: n for i, n in times.items() if n}
    tok = tokens.Encoder(tokens.tokenizer_path()).tokenizer
    for r in out:
        ids = [*tok.encode(held[r["doc_id"]]["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Nulls, empty, repeated and long rows, and columns that clash with those of the operators, through all stages; and empty tables."""
    import corpus_pipeline

    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "and"]) + str(rng.randrange(50)) for _ in range(n))
    rows = [(i, prose(60), "en", f"s{i % 3}" if i % 4 else None, 1) for i in range(40)]
    rows += [rows[5], (41, None, None, None, None), (42, "", "en", "s1", 0), (None, prose(30), "en", "s1", 3), (None, None, None, None, None), (43, prose(30_000), "en", "s2", 4), (44, "x" * 50_000, "en", "s2", 4), (45, rows[3][1], "en", "s2", 4)]
    clash = "*, 'c' as y_, 'c' as key_, 'c' as source_, 'c' as size, 'c' as u, 'c' as v, 'c' as root, 'c' as sid, 'c' as keep, 'c' as score, 'c' as times, 'c' as item, 'c' as `row`, 'c' as n_docs"
    full = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(*clash.split(", "))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, rows[7][1]), (2, None)], "item_id long, text string")
    for name, docs in (("full", full), ("empty", full.where("false"))):
        at = str(tmp_path / name)
        for table, df in (("documents", docs), ("labels", labels if name == "full" else labels.where("false")), ("benchmark", bench)):
            df.write.parquet(f"{at}/{table}.parquet")
        left = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:4]:
            left = stage(spark, left, at)
            assert left.columns == docs.columns
            left.collect()
        out = corpus_pipeline.run(spark, at).collect()
        assert (len(out) == 0) == (name == "empty")
        if out:
            assert 7 not in {r["doc_id"] for r in out} and 45 not in {r["doc_id"] for r in out}


def test_pipeline_drops_near_copies_of_similar_shingles(spark, monkeypatch):
    import corpus_pipeline
    from lexiloom.llm import similar

    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [[word() for _ in range(rng.randint(60, 200))] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    line = " ".join(word() for _ in range(12))
    for b in base:
        for k in range(1, 5):
            copy = list(b)
            for at in rng.sample(range(len(b)), k):
                copy[at] = word()
            texts.append(" ".join(copy))
    texts += [f"{line} {word()} {word()}" for _ in range(8)] + [" ".join(word() for _ in range(30)) + " " + line for _ in range(8)] + ["a b", "a b", "a c", ""]
    for n in range(40):  # copies of one text that are similar to it but not to each other
        copy = list(base[0])
        for at in rng.sample(range(len(copy)), len(copy) // 60 + 1):
            copy[at] = word()
        texts.append(" ".join(copy))
    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    own = [sets(t) for t in texts]
    from tests.llm.test_text_ops import components

    near = lambda a, b: 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])
    root = components(list(range(len(texts))), near)
    docs = spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in enumerate(texts)] + [(None, texts[0], "", 2, ""), (3, texts[3], "again", 3, "")], "doc_id long, text string, sid string, n int, key string")
    docs = docs.unionByName(spark.createDataFrame([(len(texts), None, None, None, None)], docs.schema))  # null: as the empty text
    expected = sorted([-1, 3, *(i for i in range(len(texts)) if root[i] == i)])
    for block, rounds in ((similar.BLOCK, similar.ROUNDS), (7, 1)):  # the blocks that a key's texts are dealt in decide nothing
        monkeypatch.setattr(similar, "BLOCK", block)
        monkeypatch.setattr(similar, "ROUNDS", rounds)
        found = corpus_pipeline.near_dedup(spark, docs, "")
        assert found.columns == docs.columns
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in found.collect()) == expected
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


def test_bands_are_asked_only_for_what_simhash_has_not_joined(spark, monkeypatch):
    from lexiloom.llm import similar, simhash

    rng = random.Random(9)
    text = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join([*text[:-1], "other"])), (3, "something else entirely here now")], "doc_id long, text string")
    partners, links, named = similar._partners, simhash.links, []

    def seen(held, every):
        out = partners(held, every)
        named.append([tuple(r) for r in out.collect()])
        return out

    monkeypatch.setattr(similar, "_partners", seen)
    assert [r["doc_id"] for r in similar.keep_one(docs).orderBy("doc_id").collect()] == [1, 3] and not any(named)
    named.clear()
    monkeypatch.setattr(simhash, "links", lambda fps: links(fps).where("false"))
    assert [r["doc_id"] for r in similar.keep_one(docs).orderBy("doc_id").collect()] == [1, 3] and len(named[0]) == 1


def test_registered_queries_follow_their_contracts(spark, data):
    from lexiloom.llm.registry import QUERIES

    columns = {
        "op1_ann": ["query_id", "rank", "vec_id", "score"], "op2_langid": ["doc_id", "held_out", "lang_pred", "score"], "op3_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op4_substring": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op5_mix": ["doc_id", "size", "source_size", "target", "taken"], "op6_tokens": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op7_lines": ["doc_id", "n_lines", "n_dropped", "kept_sha256"], "op8_quality": ["doc_id", "held_out", "score", "predicted"], "op9_decontaminate": ["doc_id", "item_id", "score"], "op10_simhash": ["doc_id", "fingerprint", "component_id"],
    }
    assert set(columns) == set(QUERIES)
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    for name, own in columns.items():
        got = QUERIES[name](spark, data)
        assert set(own) <= set(got.columns), name
        if name in ("op2_langid", "op4_substring", "op5_mix", "op6_tokens", "op7_lines", "op8_quality", "op10_simhash"):
            assert got.count() == n, name


def test_held_out_accuracy(spark):
    from lexiloom.llm.registry import QUERIES

    data = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = [r for r in QUERIES["op2_langid"](spark, data).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    held = [r for r in QUERIES["op8_quality"](spark, data).collect() if r["held_out"] and r["doc_id"] in label]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in held) >= 0.95 * len(held)
