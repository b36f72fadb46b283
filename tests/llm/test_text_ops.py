"""Text operators against brute force on awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

WHITE = r"[^\x20\x09-\x0D]+"


def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["the", "The", "of,", "é", "straße", "x\x1cy", "a b"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(70), "This very line is found in many documents."
    base = prose(300)
    near = base.split()
    near[150] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n\x0b "), (7, "one"), (8, "two words"), (9, prose(40) + " " + passage + "\n" + line),
        (10, passage + " " + prose(60) + "\n" + line.upper()), (11, line + "\n\n  " + line + "\t\n" + prose(5)), (12, prose(30) + "\r\n" + line), (13, "same " * 300), (14, "same " * 120),
        (15, prose(20_000)), (16, prose(49)), (17, passage[: len(passage) // 2]), (18, "Q" * 30_000),
    ]
    out = [(i, t, "en", f"src{i % 4}" if i % 5 else None) for i, t in texts]
    return [*out, out[0], out[8], (None, base, None, None), (None, None, None, "src1")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").repartition(3)
    for name in ("fp", "node", "key", "th", "size", "u", "v", "rank", "component_id", "source_", "n_words", "kept", "h1", "k1", "page", "row", "times", "stop"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


def norm(r):
    return sorted(map(tuple, r), key=repr)


def simhash(text):
    import xxhash

    w = re.findall(WHITE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    votes = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(s))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs):
    from lexiloom.llm.simhash import keep_one, near_duplicates

    fps = {i: simhash(t) for i, t, *_ in rows() if i is not None}
    root = components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    want = [(i, simhash(t), None if i is None else root[i]) for i, t, *_ in rows()]
    got = [(r[0], r[1] & (1 << 64) - 1, r[2]) for r in near_duplicates(docs).collect()]
    assert norm(got) == norm(want)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted({r["doc_id"] for r in kept.collect() if r["doc_id"]}) == sorted({i for i in root if root[i] == i})


def test_golay_keys_meet_within_two_bits():
    import numpy as np

    from lexiloom.llm.simhash import Golay

    rng, golay = np.random.default_rng(1), Golay()
    assert all(len(set(p)) in (1, 6) for p in golay.patterns.tolist())
    x = rng.integers(0, 1 << 23, 3000).astype(np.uint32)
    flip = (np.uint32(1) << rng.integers(0, 23, 3000).astype(np.uint32)) | (np.uint32(1) << rng.integers(0, 23, 3000).astype(np.uint32))
    for a, b in zip(golay.keys(x).tolist(), golay.keys(x ^ flip).tolist(), strict=True):
        assert set(a) & set(b)


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    """A ball of fingerprints shares keys far beyond the bucket limit; the linear path must link the same."""
    from lexiloom.llm import simhash as S
    from lexiloom.llm.common import connected_components

    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(60)})
    signed = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    want = components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for limit in (4, 1024):
        monkeypatch.setattr(S, "BUCKET", limit)
        found = dict(map(tuple, connected_components(S.links(spark.createDataFrame(signed, "fp long, node long"))).collect()))
        assert {i: found.get(i, i) for i in want} == want


def test_components(spark):
    from lexiloom.llm.common import connected_components

    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5), (None, 7), (1001, 1000)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring(docs):
    from lexiloom.llm.substring import substring_dedup

    split = lambda t: (t or "").encode().split()
    for window in (50, 7):
        first = {}
        for i, t, *_ in rows():
            w = split(t)
            for k in range(len(w) - window + 1) if i is not None else ():
                g = tuple(w[k : k + window])
                first[g] = min(i, first.get(g, i))
        want = []
        for i, t, *_ in rows():
            w, gone = split(t), set()
            for k in range(len(w) - window + 1) if i is not None else ():
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
            want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
        got = [
            (r["doc_id"], r["n_words"], r["n_removed"], r["whole"].hex() if r["kept"] is None else hashlib.sha256(r["kept"].encode()).hexdigest())
            for r in substring_dedup(docs, window).collect()
        ]
        assert norm(got) == norm(want)


@pytest.mark.parametrize("bits", [1 << 28, 1 << 3])
def test_lines(docs, bits):
    from lexiloom.llm.lines import line_dedup

    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    where = {}
    for i, t, *_ in rows():
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                where.setdefault(key(x), set()).add(i)
    want = []
    for i, t, *_ in rows():
        ls = (t or "").split("\n")
        keep = [x for x in ls if i is None or len(where.get(key(x), ())) < 3 or max(where[key(x)]) == i]
        want.append((i, len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    got = [
        (r["doc_id"], r["n_lines"], r["n_dropped"], r["whole"].hex() if r["kept"] is None else hashlib.sha256(r["kept"].encode()).hexdigest())
        for r in line_dedup(docs, most_bits=max(bits, 1 << 18)).collect()
    ]
    assert norm(got) == norm(want) and any(w[2] for w in want)


def test_tokens(docs):
    import numpy as np

    from lexiloom.llm import tokens as T

    tok = T.Encoder(T.tokenizer_path()).tokenizer
    got = sorted(T.encode_table(docs, T.tokenizer_path()).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, *_ in rows()), key=lambda i: -1 if i is None else i)
    ids = lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert norm((r["doc_id"], bytes(r["ids"])) for r in got) == norm((i, ids(t)) for i, t, *_ in rows())
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    assert zlib.crc32(b"") == 0


def test_token_file_round_trip(tmp_path):
    import numpy as np

    from lexiloom.llm import tokens as T

    rng = np.random.default_rng(2)
    size = np.array([0, 3, 70_000, 0, 131_072, 1, 0])
    ids = rng.integers(0, 50_000, size.sum()).astype(np.uint32)
    told = {}
    (tmp_path / "a").write_bytes(b"".join(T.file_bytes(iter([(np.arange(7), size, ids)]), told)))
    back = list(T.read_file(str(tmp_path / "a")))
    assert (np.concatenate([x[2] for x in back]) == ids).all() and np.concatenate([x[1] for x in back]).tolist() == size.tolist() and told["n_ids"] == len(ids)
    with pytest.raises(ValueError):
        (tmp_path / "b").write_bytes(b"x" * 40)
        list(T.read_file(str(tmp_path / "b")))


def test_encoder_equals_the_tokenizer():
    import pyarrow as pa
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from lexiloom.llm import tokens as T

    e = T.Encoder(T.tokenizer_path())
    assert e.cuts

    @settings(max_examples=200, deadline=None)
    @given(st.text(max_size=40) | st.text("abcXYZ019'!&*-_<|>sStTréÀßÿ÷ªº²Σσİ \n\t", max_size=40))
    def same(x):
        try:
            x.encode()
        except UnicodeEncodeError:
            return
        assert e.encode(pa.array([x]), None)[0].tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids

    same()


def test_empty_tables(spark):
    from lexiloom.llm import decontaminate, langid, lines, mixing, quality, simhash, substring, tokens

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    for out in (simhash.near_duplicates(none), substring.substring_dedup(none), lines.line_dedup(none), mixing.mix(none), mixing.mixed_rows(none), tokens.encode_table(none, tokens.tokenizer_path())):
        assert out.count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert langid.predict(none, *langid.learn(none)).count() == 0
    model = quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.scores(none, model).count() == 0 and quality.keep_good(none, model).count() == 0


def test_mix(docs):
    from lexiloom.llm.mixing import mix, mixed_rows

    got = mix(docs).collect()
    assert norm((r["doc_id"], r["size"]) for r in got) == norm((i, len(re.findall(WHITE, t or ""))) for i, t, *_ in rows())
    assert all(r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    sizes, targets = {}, {}
    for i, t, _, s in rows():
        sizes[s] = sizes.get(s, 0) + len(re.findall(WHITE, t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_ = 1.5 * sum(sizes.values()), set(names)
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > 2 * sizes[s]]
        if not over:
            targets |= part
            break
        for s in over:
            targets[s] = 2.0 * sizes[s]
            left -= targets[s]
            open_.remove(s)
    by = {(i, len(re.findall(WHITE, t or ""))): s for i, t, _, s in rows()}
    for r in got:
        assert abs(r["target"] - targets[by[r["doc_id"], r["size"]]]) < 1e-6
    assert norm(map(tuple, mix(docs).collect())) == norm(map(tuple, got))
    copies = mixed_rows(docs)
    assert copies.columns == docs.columns
    assert sum(len(re.findall(WHITE, r["text"] or "")) for r in copies.collect()) == sum(r["taken"] for r in got)


def test_larger_documents_are_taken_at_larger_odds(spark):
    from lexiloom.llm.mixing import mix

    many = spark.range(30_000).selectExpr("id as doc_id", "repeat('w ', cast(case when id % 2 = 0 then 10 else 160 end as int)) as text", "concat('s', id % 3) as source")
    rows = mix(many).where("target % source_size > 0").selectExpr("size", "taken div size - floor(target / source_size) as extra").groupBy("size").avg("extra").collect()
    odds = {r[0]: r[1] / (1 - r[1]) for r in rows}
    assert odds[160] / odds[10] == pytest.approx(4, rel=0.15)  # the square root of the ratio of sizes


def test_mix_comes_near_its_targets(spark):
    from lexiloom.llm.mixing import mix

    many = spark.range(20_000).selectExpr("id as doc_id", "repeat('w ', cast(10 + id % 90 as int)) as text", "concat('s', case when id % 3 = 0 then 0 else id % 7 end) as source")
    got = mix(many).selectExpr("source_size", "target", "taken").groupBy("source_size", "target").sum("taken").collect()
    assert len(got) == 7 and all(abs(r[2] - r[1]) <= 50 for r in got)


def test_langid(spark, docs):
    from lexiloom.llm.langid import learn, predict

    rng = random.Random(4)
    lex = {"xa": ["bana", "kuta", "mora", "tika"], "xb": ["strx", "qlpt", "vrzg", "hhkj"]}
    text = lambda lang, n: " ".join(rng.choice(lex[lang]) for _ in range(n))
    train = spark.createDataFrame([(i, text(k, 80), k) for i in range(60) for k in lex] + [(0, None, "xa"), (1, "z", None)], "doc_id long, text string, lang string")
    tests = [(1, text("xa", 50), "xa"), (2, text("xb", 50), "xb"), (3, None, "und"), (4, "12 ... \n", "und"), (5, "", "und"), (6, text("xa", 300) + " " + text("xb", 100), "xa"), (None, text("xb", 9000), "xb")]
    got = {r["doc_id"]: r for r in predict(spark.createDataFrame([t[:2] for t in tests], "doc_id long, text string"), *learn(train)).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in tests)
    assert sorted(got[6]["languages"]) == ["xa", "xb"] and 0.6 < got[6]["score"] < 0.9 and got[1]["languages"] == ["xa"]
    assert predict(docs, *learn(docs)).count() == len(rows())


def test_quality(spark, docs):
    from lexiloom.llm import quality

    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "of", "and"]) + rng.choice(["", "", ","]) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "$$$", "!!!", "###"]) for _ in range(80))
    rows_ = [(i, good() if i % 2 else bad()) for i in range(400)]
    table = spark.createDataFrame([*rows_, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400)] + [(0, 0), (7, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(table, labels)
    got = quality.scores(table, model).collect()
    assert all(0 <= r["score"] <= 1 for r in got) and all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in got if r["doc_id"] < 400)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and quality.scores(docs, model).count() == len(rows())
    good = {r["doc_id"] for r in quality.scores(docs, model).collect() if r["score"] >= 0.3}
    assert {r["doc_id"] for r in kept.collect()} == good
    assert quality.keep_good(docs.where("false"), model).count() == 0
    clash = table.selectExpr("*", "'c' as y_", "'c' as key_", "'c' as score")
    assert quality.train(clash, labels).base == model.base and quality.keep_good(clash, model).columns == clash.columns


def test_decontamination(spark, docs):
    from lexiloom.llm.decontaminate import contaminated, drop_contaminated

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    item = [word() for _ in range(40)]
    edited = [word() if i % 6 == 5 else x for i, x in enumerate(item)]
    noise = lambda n: " ".join(word() for _ in range(n))
    table = spark.createDataFrame(
        [(1, noise(50) + " " + " ".join(item) + " " + noise(20)), (2, noise(30) + " " + ", ".join(edited).upper() + "."), (3, noise(200)), (4, None), (5, ""), (6, " ".join(item[:9])), (None, " ".join(item))] + [(100 + i, " ".join(item)) for i in range(60)],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(7, " ".join(item)), (8, noise(30)), (9, None), (10, "a b"), (None, noise(10))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(table, bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7), *((100 + i, 7) for i in range(60))}
    assert got[1, 7]["score"] == 1 and (got[1, 7]["first_word"], got[1, 7]["last_word"]) == (50, 89) and 0.5 <= got[2, 7]["score"] < 1
    assert sorted(r["doc_id"] for r in drop_contaminated(table, bench).collect()) == [3, 4, 5, 6]
    assert drop_contaminated(docs, bench).columns == docs.columns
    assert norm(map(tuple, drop_contaminated(docs, bench).collect())) == norm(map(tuple, docs.collect()))
    assert drop_contaminated(docs.where("false"), bench).count() == 0 and drop_contaminated(table, bench.where("false")).count() == table.count()


def test_decontamination_against_all_alignments(spark):
    """Every document aligned whole with every item that it shares three neighbouring words with."""
    import numpy as np

    from lexiloom.llm import decontaminate as D

    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    items = [[rng.choice(words) for _ in range(rng.randint(3, 40))] for _ in range(12)]
    docs = []
    for k in range(80):
        text = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if k % 2:
            x = [w for w in rng.choice(items) if rng.random() > 0.12]
            x = [rng.choice(words) if rng.random() < 0.15 else w for w in x]
            at = rng.randint(0, len(text))
            text[at:at] = x
        docs.append(text)
    want = {}
    number = {w: i for i, w in enumerate(words)}
    code = lambda t: np.array([number[w] for w in t], np.uint64)
    grams = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    for i, t in enumerate(docs):
        for j, x in enumerate(items):
            if grams(t) & grams(x):
                score = D.smith_waterman(code(x), code(t))[0] / (2 * len(x))
                if score >= 0.5:
                    want[i, j] = score
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminated(table, bench).collect()}
    assert len(want) > 20 and got == pytest.approx(want)


@pytest.mark.parametrize("copies", [16, 17, 1000])
def test_decontamination_of_a_widely_copied_edit(spark, copies):
    from lexiloom.llm.decontaminate import contaminated, drop_contaminated

    item = [f"w{i}x" for i in range(40)]
    edited = [f"e{i}y" if i % 4 == 3 else x for i, x in enumerate(item)]
    table = spark.createDataFrame([(i, f"a{i} b{i} " + " ".join(edited) + f" c{i}") for i in range(copies)] + [(5000, "w0x w1x w2x and then other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = contaminated(table, bench).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(copies)) and all(r["score"] >= 0.5 for r in got)
    assert [r["doc_id"] for r in drop_contaminated(table, bench).collect()] == [5000]


def test_bound_is_never_below_the_alignment():
    import numpy as np

    from lexiloom.llm.decontaminate import _bound, smith_waterman

    rng = np.random.default_rng(3)
    for _ in range(300):
        item, passage = rng.integers(0, 12, rng.integers(3, 20)), rng.integers(0, 20, rng.integers(3, 50))
        assert _bound(np.unique(item), passage) >= smith_waterman(item, passage)[0]


def test_a_text_of_seven_languages_gets_all_of_them():
    import numpy as np
    import pyarrow as pa

    from lexiloom.llm.langid import BUCKETS, infer, trigrams

    texts = [" ".join(a + b + c for a in x for b in x for c in x) for x in ("abc", "def", "ghi", "jkl", "mno", "pqr", "stu", "vwx")]
    row, bucket, n = trigrams(pa.array(texts))
    counts = np.full((8, BUCKETS), 0.5)
    np.add.at(counts, (row, bucket), 1000 * n)
    share, _ = infer(pa.array([" ".join(texts[:7]), texts[7]]), np.log(counts / counts.sum(axis=1, keepdims=True)))
    assert (share[0] > 0).sum() == 7 and share[0, 7] == 0 and (share[1] > 0).sum() == 1


def test_batches_are_gathered_for_the_encoder():
    import pyarrow as pa

    from lexiloom.llm.tokens import gathered

    texts = ["a" * 10, None, "b" * 10, "c" * 10, "", "d" * 45, "e"]
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([i]), "text": pa.array([x], pa.string())}) for i, x in enumerate(texts)]
    got = list(gathered(iter(batches), 1, 30))
    assert [b.num_rows for b in got] == [5, 1, 1]
    assert [x for b in got for x in b.column(1).to_pylist()] == texts
    assert list(gathered(iter([]), 1, 30)) == []
