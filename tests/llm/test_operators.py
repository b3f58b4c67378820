"""Each corpus operator against brute force on small tables with nulls, empty, long and repeated rows and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, licenses, media, pieces, quality, sharding, simhash, suffixes, urlrules
from tessera.llm.common import text_view

LOW = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, fp string, `doc.x` string"


def prose(rng, n, vocabulary=900):
    return " ".join(f"w{int(i)}é" if i % 9 == 0 else f"w{int(i)}" for i in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    base = [prose(rng, int(n)) for n in rng.integers(5, 260, 60)]
    shared = prose(rng, 120)
    near = base[0] + " " + base[1]
    out = [
        *base, base[3], base[3], base[4].upper(), None, "", "", " \n\t ", "one", "two words", "two words", near, near.replace("w", "W", 1), near + " end",
        base[7] + " " + shared + " " + base[8], base[9] + "\n" + shared, shared[:700] + prose(rng, 50), "a" * 1500, "ab" * 900, "é" * 700, prose(rng, 6000), "▁ literal ▁▁", "x" * 5000 + " " + "y" * 100,
        "Tail.\nReleased under the MIT License.\nMore.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.", "He got a driver license last week and a copy of the form.",
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 70 else i, t, "en", "s", len(t or ""), "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], rows[20]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(tuple(r[c] for c in columns))
    return out


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def check(df, docs, want, *columns):
    """Every row of docs has its wanted result, as often as it occurs."""
    got, expected = Counter(), Counter()
    for r in df.select("doc_id", *columns).collect():
        got[tuple(r)] += 1
    for i, t in rows_of(docs):
        expected[(i, *want(i, t))] += 1
    assert got == expected


# --- SimHash


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(prints):
    """{id: least id reachable}; None is left out of the least."""
    ids, parent = list(range(len(prints))), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids[:a]:
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k in ids:
        if prints[k][0] is not None:
            least[find(k)] = min(least.get(find(k), prints[k][0]), prints[k][0])
    return [least.get(find(k)) for k in ids]


def test_simhash_equals_brute_force(docs):
    rows = rows_of(docs)
    prints = [(i, brute_print(t)) for i, t in rows]
    want = Counter((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints), strict=True))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_print("fp").alias("f"), "component_id")
    assert Counter(tuple(r) for r in got.collect()) == want


def test_xxh64_equals_the_library():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 4000, dtype=np.uint8)
    for size in (1, 3, 4, 7, 8, 12, 31, 32, 33, 63, 64, 100, 255):
        at = np.arange(0, 3000, 97)
        assert simhash.xxh64(buf, at, size).tolist() == [xxhash.xxh64_intdigest(buf[a : a + size].tobytes(), 42) for a in at]


@pytest.mark.parametrize("block", [20_000, 7])
def test_links_survive_blocks(spark, block, monkeypatch):
    """Random balls of fingerprints: components are those of all pairs, also if signatures are cut into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(9)
    values = set()
    for center in rng.integers(0, 1 << 63, 12):
        for _ in range(25):
            x = int(center)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            values.add(x if x < 1 << 63 else x - (1 << 64))
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    labels = {r["fp"]: r["one"] for r in simhash.classes(df.withColumn("id", F.col("fp")), F.min("id")).collect()}
    want = brute_components([(v, v & ((1 << 64) - 1)) for v in values])
    assert [labels[v] for v in values] == want


def test_keep_one_keeps_the_least_of_each_group(docs, texts):
    rows = rows_of(docs)
    comp = brute_components([(i, brute_print(t)) for i, t in rows])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    groups = {c for c in comp if c is not None}
    assert len(got) == len(groups) + sum(1 for c in set(comp) if c is None)
    assert {i for i in got if i is not None} <= groups


# --- Decontamination


def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute_contamination(items):
    windows = defaultdict(set)
    for name, t in items:
        w = brute_words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(name))
    sizes = sorted({len(x) for x in windows})

    def of(_, t):
        w, hit, names = brute_words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    names |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)

    return of


@pytest.mark.parametrize("block_bytes", [1 << 24, 500])
def test_contamination_equals_brute_force(spark, docs, texts, block_bytes):
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    items = [(1, cut(texts[0], 0, 30)), (2, cut(texts[5], 3, 16).upper()), (3, "two words"), (4, None), (5, "..."), (6, cut(texts[0], 10, 40)), (7, cut(texts[-7], 500, 620)), (8, "nowhere at all in any of these rows or so it seems today"), (6, cut(texts[9], 0, 20))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(docs, table, block_bytes=block_bytes)
    check(got, docs, brute_contamination(items), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for r in got.select("doc_id", "n_hit", "spans").collect():
        assert sum(s["end_word"] - s["word"] for s in r["spans"]) == r["n_hit"]
    of = brute_contamination(items)
    kept = decontam.without_contaminated(docs, table)
    assert kept.columns == docs.columns and Counter(rows_of(kept)) == Counter((i, t) for i, t in rows_of(docs) if not of(i, t)[4])


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (1, 5, 200, 40, 40)] + [np.append(np.ones(70, int), 0)] * 2)
    fm = decontam.FMIndex(text, 4)
    for size in (1, 2, 5):
        patterns = np.array(np.meshgrid(*[[1, 2, 3, 4]] * size)).reshape(size, -1).T
        found, lo, hi = fm.search(patterns, np.full(len(patterns), size))
        got = {tuple(patterns[f]): sorted(fm.locate(np.arange(a, b)).tolist()) for f, a, b in zip(found, lo, hi, strict=True)}
        want = defaultdict(list)
        for k in range(len(text) - size + 1):
            if text[k : k + size].all():
                want[tuple(text[k : k + size])].append(k)
        assert got == dict(want)


# --- Repeats


def brute_repeats(rows):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 399):
            count[b[s : s + 400]] += 1

    def of(_, t):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 399):
            if count[b[s : s + 400]] > 1:
                cover[s] += 1
                cover[s + 400] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        return len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()

    return of


@pytest.mark.parametrize("hot", [4000, 1])
def test_repeats_equal_brute_force(docs, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffixes, "MERGE_BYTES", 20_000)
    monkeypatch.setattr(suffixes, "RUN_BYTES", 30_000)
    check(suffixes.remove_repeats(docs), docs, brute_repeats(rows_of(docs)), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_remaining_texts_are_whole_characters(docs):
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns
    of = brute_repeats(rows_of(docs))
    texts = dict(rows_of(docs))
    for r in out.collect():
        n, gone, _, _ = of(0, texts[r["doc_id"]])
        assert len(r["text"].encode()) <= n - gone and r["n_chars"] == len(r["text"])
        if not gone:
            assert r["text"] == (texts[r["doc_id"]] or "")


def test_loser_tree_merges_with_shared_prefixes():
    rng = np.random.default_rng(4)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 12), dtype=np.uint8)) for _ in range(n)) for n in (40, 0, 1, 77, 13)]
    tree = suffixes.LoserTree([(r, suffixes.neighbours(r).tolist()) for r in runs])
    out = [(runs[i][k], c) for i, k, c in tree]
    assert [t for t, _ in out] == sorted(t for r in runs for t in r)
    for (a, _), (b, c) in zip(out, out[1:], strict=False):
        assert c == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    numbers = {k: np.arange(40) for k in ("row", "pos", "ctx", "block", "copies", "near", "far")}
    texts, fronts, back = suffixes.read_run(suffixes.write_run(runs[0], [t[::-1] for t in runs[0]], numbers))
    assert texts == runs[0] and fronts == [t[::-1] for t in runs[0]] and back["pos"].tolist() == list(range(40))


# --- Pieces


def test_pieces_equal_the_library_and_decode_exactly(docs, texts, spark):
    import sentencepiece

    vocabulary = pieces.Pieces.load()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = pieces.encode_pieces(docs, vocabulary)
    for r in out.select("doc_id", "ids", "n_tokens", "exact", "ids_sha256").collect():
        t = dict(rows_of(docs))[r["doc_id"]] or ""
        assert r["exact"] and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest()
        if "▁" not in t:
            assert r["ids"] == model.encode(t)
    back = pieces.decode_pieces(out, vocabulary)
    assert Counter(rows_of(back)) == Counter((i, t or "") for i, t in rows_of(docs))


def test_pieces_of_odd_texts():
    import sentencepiece

    vocabulary = pieces.Pieces.load()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = ["", " ", "  lead", "tail  ", "a\n\n  b\tc", "你好 world 😀é", "----------------====", "\x00\x7f", "x" * 300, "ñandú çà œuvre", "    " * 9]
    data, off = text_view(pa.array(odd))
    ids, at = vocabulary.encode(data, off, pieces.Kept(vocabulary))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(odd))] == [model.encode(t) for t in odd]


# --- Sharding


def test_shards_are_near_equal_and_gapless(docs, empty):
    out = sharding.histogram_shards(docs, n_shards=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows_of(docs))
    size, slots = Counter(), defaultdict(list)
    for r in out:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    largest = max(r["size"] for r in out)
    assert max(size.values()) - min(size.values()) <= 2 * largest and set(size) <= set(range(4))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.histogram_shards(empty).count() == 0


def test_a_hot_text_is_cut_across_shards(spark):
    df = spark.createDataFrame([(i % 3, "same" if i % 3 else f"t{i}") for i in range(600)], "doc_id long, text string")
    out = sharding.histogram_shards(df, n_shards=8).toPandas()
    n = out.groupby("shard")["size"].sum()
    assert n.max() - n.min() <= 20 and len(n) == 8


# --- URLs


def test_urls(spark):
    urls = ["http://a.example.com/en/7x", "https://EXAMPLE.com/en/8?q=/en/7", "http://notexample.com/en/7", "x://net/de/8", "http://b.example.net/de/81", "http://org/es/", "http://org/es", None, "no scheme", "http://a.com", "http://com/en/#x", "://x.org/es/y", "http://example.com/EN/7"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")

    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOW)
        fits = [(len(h + p), h + p, v) for h, p, v in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = Counter(tuple(r) for r in urlrules.judge_urls(df, urlrules.rules_frame(spark)).collect())
    assert got == Counter((i, *want(u)) for i, u in [*enumerate(urls), (0, urls[0])])
    plan = urlrules.judge_urls(df, urlrules.rules_frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- Media


def png():
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes([0, 0, 0, 1, 0, 0, 0, 1, 8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_media_are_recognised_corrected_and_carved(spark):
    import gzip

    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(9) + b"\x02\x02\x44\x01\x00" + b"\x3b"
    rows = [(1, png(), "jpeg"), (2, media.wav(b"abc"), None), (3, b"text" + png() + b"more" + gif, "bin"), (4, png()[:-3], "png"), (5, b"", None), (6, None, "x"), (7, gzip.compress(b"hi"), "zip"), (8, media.wav(png()), "wav"), (9, b"BM and RIFF and %PDF- and PK\x03\x04", "txt")]
    got = {r["id"]: r for r in media.sniff_media(spark.createDataFrame(rows, "id long, data binary, declared string"), "id", "data", "declared").collect()}
    assert [got[i]["detected"] for i in range(1, 10)] == ["png", "wav", None, None, None, None, "gzip", "wav", None]
    assert [got[i]["corrected"] for i in range(1, 10)] == ["png", "wav", "bin", "png", None, "x", "gzip", "wav", "txt"]
    assert [(e["kind"], e["offset"], e["bytes"]) for e in got[3]["embedded"]] == [("png", 4, bytearray(png())), ("gif", 8 + len(png()), bytearray(gif))]
    assert [e["kind"] for e in got[8]["embedded"]] == ["png"]


def test_text_media(docs):
    def want(_, t):
        b = (t or "").encode()
        p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media.wav(p)), hashlib.sha256(media.wav(p)).hexdigest()

    out = media.text_media(docs)
    check(out, docs, want, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    assert out.select("payload_sha256", "feature").distinct().count() == out.select("payload_sha256").distinct().count()


# --- Classifiers


def labelled(spark):
    rng = np.random.default_rng(8)
    langs = {"xx": "alpha beta gamma delta".split(), "yy": "uno dos tres cuatro".split(), "zz": "ichi ni san shi".split()}
    rows = []
    for i in range(240):
        lang = list(langs)[i % 3]
        w = [f"{x}{y}" for x, y in zip(rng.choice(langs[lang], 40), rng.choice(langs[lang], 40), strict=True)]
        good = i % 4 > 0
        rows.append((i, " ".join(w) + "." if good else " ".join(f"{x}%%%" for x in w), lang if i % 10 else None, int(good)))
    rows += [(1000, None, "xx", 1), (1001, "", None, None), (1002, "12 .. 34", "yy", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_languages_of_held_out_rows(spark, empty):
    df = labelled(spark)
    got = {r["doc_id"]: r for r in langid.identify_languages(df).collect()}
    want = {r["doc_id"]: r["lang"] for r in df.collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i in got if i < 1000 and got[i]["held_out"] and want[i]]
    assert len(held) > 20 and np.mean([got[i]["lang_pred"] == want[i] for i in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify_languages(empty).count() == 0


def brute_language(rows, train, tiers):
    """{language: {n-gram: share}} by plain dictionaries, and the best languages of a text by exact membership."""
    def folded(t):
        b = (t or "").translate(LOW).encode()
        b = re.sub(rb" +", b" ", b" " + bytes(x if 97 <= x <= 122 or x >= 128 else 32 for x in b) + b" ")
        return [b[k : k + langid.GRAM] for k in range(len(b) - langid.GRAM + 1)]

    held = defaultdict(Counter)
    for t, lang in train:
        held[lang].update(folded(t))
    share = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in held.items()}

    def of(t):
        got = {k: sum(c.get(g, -1) >= x for g in folded(t) for x in tiers) for k, c in share.items()}
        return got

    return of


def test_languages_equal_exact_membership(spark):
    """The filters lose nothing: popcounts are those of exact sets, up to false positives, on rows with nulls, repeats,
    ties, a very long text and clashing names."""
    base = [(r["doc_id"], r["text"], r["lang"]) for r in labelled(spark).collect()]
    rows = [*base, base[4], base[4], (None, "uno dos", "yy"), (2000, base[1][1] * 300, None), (2001, "q", "zz"), (2002, "ß ü", None)]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "doc_id long, text string, lang string, id string, lang_pred string, score string")
    train = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2]
    of = brute_language(rows, train, langid.TIERS)
    got = langid.identify_languages(df).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in got:
        t = text[r["doc_id"]]
        if r["lang_pred"] == "und":
            assert not any(map(str.isalpha, t or "")) and r["score"] == 0
            continue
        want = of(t)
        total, top = sum(want.values()), max(want.values())
        assert want[r["lang_pred"]] >= 0.98 * top and (not total or abs(r["score"] - top / total) < 0.05)
    model = langid.fit_languages(df)
    for lang in model.languages:  # every n-gram of the sample is returned for its language
        data, off = text_view(pa.array([t for _, t, x in rows if x == lang], pa.string()))
        h, _ = langid.grams(data, off)
        assert model.bit(model.probe(h), len(langid.TIERS) * model.languages.index(lang)).all()


def test_quality_of_held_out_rows(spark, empty):
    df = labelled(spark)
    labels = df.where("quality IS NOT NULL").select("doc_id", "quality")
    labels = labels.unionByName(labels.limit(3))  # repeated labels
    got = {r["doc_id"]: r for r in quality.judge_quality(df, labels).collect()}
    want = {r["doc_id"]: r["quality"] for r in df.collect()}
    held = [i for i in got if i < 1000 and got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i]["predicted"] == want[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert quality.judge_quality(empty, labels.limit(0)).count() == 0
    kept = quality.keep_good(df, quality.contract_model(df, labels))
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["predicted"]}


def test_statistics_do_not_depend_on_neighbours(texts):
    whole = quality.statistics(*text_view(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(*text_view(pa.array([t], pa.string())))[0], whole[i], atol=1e-5)


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_trees(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    for i in range(0, 400, 57):
        total = model.bias
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            k = 0
            for _ in range(quality.DEPTH):
                k = 2 * k + 1 + int(x[i, f[k]] > t[k])
            total += v[k]
        assert abs(model.score(x[i : i + 1])[0] - 1 / (1 + np.exp(-total))) < 1e-12
    one = quality.fit_trees(x, np.ones(400))
    assert len(set(one.score(x))) == 1


# --- Licences


def test_licences(docs, texts, empty):
    model = licenses.train()
    out = licenses.scan_licenses(docs, model)
    got = by_id(out, "n_paragraphs", "n_licences", "families", "family", "paragraph")
    want = {len(texts) - 4: (3, 1, "mit", "mit", 1), len(texts) - 3: (1, 1, "cc-by-nc", "cc-by-nc", 0)}
    for i, row in want.items():
        assert got[i] == [row]
    assert got[len(texts) - 2][0][:3] == (2, 2, "gpl,proprietary")
    assert all(r[1] == 0 and r[3] is None for i, rs in got.items() if i is None or i < len(texts) - 4 for r in rs)
    assert got[len(texts) - 1][0][1] == 0
    assert sum(map(len, got.values())) == docs.count()
    assert licenses.scan_licenses(empty, model).count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_columns_and_python_make_the_same_grams(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "", "the of", "MIT", "a b c MIT-0 (x)"]
    tokens = F.filter(F.split(F.lower("line"), licenses.TOKEN), lambda t: t != "")
    for r in spark.createDataFrame([(x,) for x in lines], "line string").select("line", licenses._column_grams(tokens).alias("g")).collect():
        assert sorted(r["g"]) == licenses.grams(r["line"])


# --- Empty tables


def test_empty_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert suffixes.remove_repeats(empty).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(empty, items).count() == 0
    assert pieces.encode_pieces(empty, pieces.Pieces.load()).count() == 0
    assert media.text_media(empty).count() == 0
    assert urlrules.judge_urls(spark.createDataFrame([], "page_id long, url string"), urlrules.rules_frame(spark)).count() == 0


def test_no_items_hit_nothing(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, items).agg(F.sum("n_hit"), F.count("*")).first()[:] == (0, docs.count())
