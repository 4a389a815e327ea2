"""The training-data operators against brute force on small tables, odd rows included."""

import base64
import collections
import gzip
import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from codelode.llm import chat, components, decontam, langid, media, mixing, neardup, passages, queries, secrets, sharding, warc
from codelode.llm.common import prefix_sums

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, _p string, tkey long"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest documents and odd ones: nulls, empties, a very long text, ties, repeated rows, clashing columns."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = rows[3][1]
    rows += [(9001, None, None, None), (9002, "", "en", None), (9003, base, "fr", "s"), (9003, base, "fr", "s"), (9004, base + " x", None, "s"), (None, base, "en", "s")]
    rows += [(9005, "  \n ", "en", "z"), (9006, "one two", "en", "z"), (9007, "ONE two", "en", "z"), (9008, "12 34 !!", "en", "z"), (9009, " ".join(f"w{i}" for i in range(60_000)), "en", "z")]
    return spark.createDataFrame([(*r, 1, 0.5, "p", 7) for r in rows], DOC)


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(spark, docs):
    rows = [(r["doc_id"], shingles(r["text"])) for r in docs.collect()]
    sets = {i: s for i, s in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = [tuple(r) for r in neardup.near_duplicates(docs).collect()]
    want = [(i, len(s), None if i is None else find(i), True if i is None else find(i) == i) for i, s in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_in_a_family(spark):
    """Many variants of one text, some too far to link: components equal brute force."""
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        t = list(base)
        for k in range(1 + i % 7):
            t[(i * 7 + k * 29) % 120] = f"x{i}_{k}"
        texts.append(" ".join(t))
    sets = [shingles(t) for t in texts]
    edges = [(a, b) for a, b in itertools.combinations(range(150), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = list(range(150))
    for _ in range(150):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == dict(enumerate(label))


def test_near_duplicates_in_a_crowd(spark, monkeypatch):
    """Pages of one template, which share buckets, and among them linked ones that neither pivot nor hub joins."""
    import random

    rng = random.Random(3)
    template = [f"t{i}" for i in range(90)]
    texts = []
    for g in range(90):
        own = [f"u{g}_{i}" for i in range(40)]
        texts.append(" ".join(template + own))
        for k in range(g % 3):
            texts.append(" ".join(template + own[: 40 - 2 * k] + [f"v{g}_{k}_{i}" for i in range(3)]))
    long = [f"l{i}" for i in range(200)]
    texts += [" ".join([*long, f"z{i}"]) for i in range(120)]
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    edges = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(edges) < 8000
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for crowd in (2, neardup.CROWD, 10_000):
        monkeypatch.setattr(neardup, "CROWD", crowd)
        assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == dict(enumerate(label)), crowd


def test_rarest_shingles_join_every_link(spark):
    """Whatever the sets, two of similarity 0.75 share one of their rarest shingles."""
    import random

    rng = random.Random(12)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randint(5, 40))]
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(60)}"
            texts.append(" ".join(t))
    texts = sorted(set(texts))
    sets = [shingles(t) for t in texts]
    df = spark.createDataFrame([(i, t, i, len(s)) for i, (t, s) in enumerate(zip(texts, sets, strict=True))], "id long, text string, comp long, n long").withColumn("tkey", F.xxhash64("text"))
    by = {}
    for r in neardup._rarest(df.select("id", "comp"), df, lambda keys: df.select(F.col("id").alias("doc_id"), "tkey", "text"), 0.75)[0].collect():
        by.setdefault(r["shingle"], set()).add(r["id"])
    joined = {p for ids in by.values() for p in itertools.combinations(sorted(ids), 2)}
    links = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert links and links <= joined


def test_estimate_is_corrected(spark):
    import numpy as np

    from codelode.llm.grams import mix

    rng = np.random.default_rng(1)
    a = mix(rng.integers(0, 1 << 60, 3000).astype(np.uint64))
    b = np.concatenate((a[:2400], mix(rng.integers(0, 1 << 60, 600).astype(np.uint64))))
    true = 2400 / 3600
    for functions, bits, n, room in ((neardup.COARSE, neardup.BITS, neardup.HASHES, 0.2), (neardup.FINE, neardup.FINE_BITS, neardup.FINE_HASHES, 0.06)):
        pair = [neardup.packed(neardup.minima(np.unique(x), functions), bits).tolist() for x in (a, b)]
        got = spark.createDataFrame([tuple(pair)], "x array<long>, y array<long>").select(neardup.estimate("x", "y", n, bits)).first()[0]
        assert abs(got - true) < room


def test_estimate_of_small_sets():
    """Chance collisions of bits are independent between functions, however small the sets."""
    import numpy as np

    from codelode.llm.grams import mix

    rng = np.random.default_rng(3)
    for common, a, b in ((3, 1, 0), (6, 1, 1), (6, 2, 0), (9, 2, 1), (12, 2, 2)):
        low = 0
        for _ in range(150):
            x = mix(rng.integers(0, 1 << 60, common + a + b).astype(np.uint64))
            pair = [np.unpackbits(neardup.packed(neardup.minima(np.unique(y), neardup.FINE), neardup.FINE_BITS).view(np.uint8)).reshape(neardup.FINE_BITS, -1) for y in (x[: common + a], np.concatenate((x[:common], x[common + a :])))]
            same = (pair[0] == pair[1]).all(axis=0).mean()
            low += (same - 0.25) / 0.75 < 0.75 - neardup.FINE_MARGIN
        assert low == 0, (common, a, b, low)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_sums(spark):
    rows = [(p, b, o, v) for p in range(2) for b in range(3) for o, v in enumerate((5, 0, 7))]
    got = prefix_sums(spark.createDataFrame(rows, "p int, b int, o int, v long"), ["p"], ["b"], ["o"], F.col("v"), "s").orderBy("p", "b", "o").collect()
    assert [r["s"] for r in got[:9]] == [0, 5, 5, 12, 17, 17, 24, 29, 29]


def test_passages(spark, docs):
    rows = [(r["doc_id"], words(r["text"])) for r in docs.collect() if r["doc_id"] is not None and r["text"] is not None]
    at = {}
    for i, w in rows:
        for k in range(len(w) - 49):
            at.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {}
    for i, w in rows:
        own = {x for k in range(len(w) - 49) if len(at[tuple(w[k : k + 50])]) > 1 for x in range(k, k + 50)}
        if own:
            want[i] = own
    got = {}
    for r in passages.repeated_passages(docs).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert got == want
    assert passages.repeated_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("batch", [7, 10_000])
def test_passages_around_a_hot_run(spark, batch):
    """Pairs that share 10 words left of a phrase that hundreds of documents have, and so are far apart in the order."""
    word, phrase = itertools.count(), " ".join(f"p{i}" for i in range(40))
    fresh = lambda n: " ".join(f"u{next(word)}" for _ in range(n))
    texts = [f"{fresh(40)} {phrase} {fresh(60)}" for _ in range(200)]
    for _ in range(12):
        own = fresh(10)
        texts += [f"{fresh(40)} {own} {phrase} {fresh(60)}" for _ in range(2)]
    texts += [f"{fresh(3)} {phrase} {fresh(50)} " * 3, phrase, " ".join([phrase] * 30)]
    at, want = {}, {}
    for i, w in enumerate(map(words, texts)):
        for k in range(len(w) - 49):
            at.setdefault(tuple(w[k : k + 50]), set()).add(i)
    for i, w in enumerate(map(words, texts)):
        if own := {x for k in range(len(w) - 49) if len(at[tuple(w[k : k + 50])]) > 1 for x in range(k, k + 50)}:
            want[i] = own
    assert len(want) == 24
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {}
        for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
            got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == want


def test_passages_across_many_partitions(spark, monkeypatch):
    """Edges are compared level by level, whatever fits a task."""
    phrase = " ".join(f"p{i}" for i in range(60))
    texts = [f"a{i} b{i} {phrase} c{i}" for i in range(300)] + [" ".join(f"x{k}_{i // 2}" for k in range(55)) for i in range(200)] + [" ".join(f"y{i}_{k}" for k in range(70)) for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    monkeypatch.setattr(passages, "EDGES", 100)
    try:
        got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in passages.repeated_passages(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", size)
    assert got == {(i, 2, 62) for i in range(300)} | {(300 + i, 0, 55) for i in range(200)}


def test_passages_are_never_broadcast(spark, monkeypatch):
    """Its tables grow with the texts, so that no join is left to Spark's estimate of their size."""
    phrase = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"a{i}_{k}" for k in range(40)) + f" b{i // 2} {phrase} " + " ".join(f"c{i // 2}_{k}" for k in range(20)) for i in range(60)]
    seen, write = [], passages.materialize
    monkeypatch.setattr(passages, "materialize", lambda df, label: seen.append(df) or write(df, label))
    found = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plans = []
    for df in [*seen, found]:
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in rows} == {(i, 40, 101) for i in range(60)}
    assert [x for x in plans if "Broadcast" in x] == []
    assert sum("SortMergeJoin" in x for x in plans) == 2


def test_passage_inside_other_text(spark):
    shared = " ".join(f"s{i}" for i in range(70))
    texts = [" ".join(f"{c}{i}" for i in range(90)) + " " + shared + " " + " ".join(f"{c}y{i}" for i in range(40)) for c in "abcde"] + [" ".join(f"z{i}" for i in range(300))]
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(i, 90, 160) for i in range(5)}


def test_decontamination(spark, docs):
    item = "Die Katze sass auf der alten Mauer und schaute lange in den Garten, bis der Regen kam und alles still wurde."
    changed = item.replace("Katze", "Katzen").replace("lange", "lang").upper()
    near = spark.createDataFrame([(1, "Vorher. " + item + " Nachher."), (2, "x " + changed + " y"), (3, item[:40] + " ganz anders als zuvor " * 4), (4, None), (5, ""), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "kurz"), (None, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contaminated(near, bench).collect()}
    assert set(got) == {1, 2} and got[1]["edits"] == 0 and got[2]["edits"] > 0
    assert "Vorher. " + item + " Nachher."[: got[1]["end"]] and got[1]["start"] == 8
    assert {r["doc_id"] for r in decontam.contaminated(near, bench, block_chars=50).collect()} == {1, 2}
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0


def test_alignment_equals_brute_force():
    import random

    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    for _ in range(60):
        item = " ".join(rng.choices(vocabulary, k=rng.randint(10, 22)))[:160].strip()
        index, most = decontam.index_of([(1, item)], scales=(decontam.LONG,)), len(item) // 10
        text = list(item)
        for _ in range(rng.randint(0, most + 4)):
            k = rng.randrange(len(text))
            text[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        doc = " ".join(rng.choices(vocabulary, k=20)) + " " + "".join(text) + " " + " ".join(rng.choices(vocabulary, k=20))
        chars = "".join(map(chr, decontam.folded(doc, True)[0]))
        row = [0] * (len(chars) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(chars, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        assert bool(decontam.matches_of(index, [doc])[0]) == (min(row) <= most)


def test_language(spark, docs):
    got = langid.identify(docs).select("doc_id", "text", "lang", "lang_pred", "score").collect()
    assert all((r["lang_pred"] == "und") == (not r["text"] or not any(map(str.isalpha, r["text"]))) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 9000 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_unlearnt_languages_go(spark, docs):
    """Texts in other letters go, with a Latin word or by length alone; texts in learnt languages stay."""
    import random

    rng = random.Random(5)
    clean = docs.where("doc_id < 9000 and text rlike '[A-Za-z]'").select("doc_id", "text", "lang")
    foreign = [(20_000 + i, "the " * (i % 2) + " ".join("".join(chr(rng.randrange(at, at + 40)) for _ in range(5)) for _ in range(n)), None) for i, (at, n) in enumerate((at, n) for at in (0x4E00, 0x0430, 0x05D0) for n in (30, 31, 500, 5000))]
    mixed = clean.unionByName(spark.createDataFrame(foreign, "doc_id long, text string, lang string"))
    assert sorted(r["doc_id"] for r in langid.in_known_language(mixed).collect()) == sorted(r["doc_id"] for r in clean.collect())
    assert langid.in_known_language(mixed.limit(0)).count() == 0


def test_known_languages_are_learnt_from_all_rows(spark):
    """Texts in letters of their own that no sample of 600 rows by id holds are learnt and stay."""
    import random

    rng = random.Random(8)
    text = lambda at: " ".join("".join(chr(at + rng.randrange(6)) for _ in range(4)) for _ in range(30))
    late = [i for i in range(50_000, 60_000) if zlib.crc32(str(i).encode()) % 4 != 2 and zlib.crc32(f"langid:{i}".encode()) >= 0.95 * 2**32][:40]
    greek = " ".join(text(0x03B1) for _ in range(2))
    df = spark.createDataFrame([(i, text(97), "xx") for i in range(2400)] + [(i, greek, "xx") for i in late], "doc_id long, text string, lang string")
    assert len(late) == 40 and langid.in_known_language(df).count() == 2440


def test_counts_of_grams_in_parts(monkeypatch):
    """Counts given out in parts add up, a text in several blocks too."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(langid, "HELD", 50, raising=False)
    rows = [("a", "abc abd " * 9), ("b", "x"), ("a", ""), ("b", "abc bcd " * 12_000)]
    got, want = collections.Counter(), collections.Counter()
    parts = list(langid._counted([pa.RecordBatch.from_pylist([{"lang": k, "text": t} for k, t in rows])]))
    for p in parts:
        for r in p.to_pylist():
            got[r["lang"], r["gram"]] += r["n"]
    for k, t in rows:
        want.update((k, g) for g in np.concatenate(list(langid._grams(t))).view(np.int64).tolist())
    assert got == want and len(parts) > 3


def plain_grams(text):
    """Every run of 3 and 4 characters of the folded text between spaces, as code points."""
    out, before = [], True
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        if c.isalpha():
            out.append(ord(low))
            before = False
        elif not before:
            out.append(32)
            before = True
    if text and not text[0].isalpha():
        out.insert(0, 32)
    out = [32, *out, 32]
    return [tuple(out[k : k + q]) for q in (3, 4) for k in range(len(out) - q + 1)]


def plain_slots(gram):
    """Where the three probes of an n-gram lie, by plain integers."""
    m, h = 2**64, 0
    for c in gram:
        h = (h * (0x9E3779B97F4A7C15 | 1) + c) % m
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % m
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB % m
    h = (h ^ (h >> 31)) ^ len(gram)
    return tuple((h >> (20 * j)) & ((1 << 18) - 1) for j in range(3))


def plain_model(by_lang, keep=6000, least=3, share=0.4):
    """{language: set of slots}: n-grams that occur ``least`` times and have ``share`` of their frequency in the language."""
    counts = {k: collections.Counter(g for t in texts for g in plain_grams(t)) for k, texts in by_lang.items()}
    freq = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    every = collections.Counter()
    for f in freq.values():
        every.update(f)
    fit = {k: [(-freq[k][g], g) for g, n in c.items() if n >= least and freq[k][g] >= share * every[g]] for k, c in counts.items()}
    assert all(len(v) <= keep for v in fit.values())
    return {k: {s for _, g in v for s in plain_slots(g)} for k, v in fit.items()}


def plain_verdict(model, text):
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0, {}
    grams = [plain_slots(g) for g in plain_grams(text)]
    wrong = {k: (len(v) / 2**18) ** 3 for k, v in model.items()}
    found = {k: max(0.0, (sum(all(s in v for s in g) for g in grams) - len(grams) * wrong[k]) / (1 - wrong[k])) for k, v in model.items()}
    best = max(found, key=found.get)
    return best, found[best] / sum(found.values()) if sum(found.values()) else 0.0, found


def test_language_against_plain_python(spark):
    """Training and every verdict over a whole table, where all training rows are in the sample."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    by_lang = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            by_lang.setdefault(r["lang"], []).append(r["text"])
    model = plain_model(by_lang)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op9_langid(spark, SF).collect()}
    for r in rows:
        lang, score, _ = plain_verdict(model, r["text"])
        assert got[r["doc_id"]][0] == lang and abs(got[r["doc_id"]][1] - score) < 1e-9


def test_seventy_languages(spark):
    """More languages than a word has bits: each is learnt, and hits and verdicts equal plain Python's."""
    import random

    rng = random.Random(6)
    vocabulary = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 7))) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(rng.choices(vocabulary[k], k=25)), k) for i, k in enumerate(sorted(vocabulary) * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    by_lang = {}
    for i, t, k in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            by_lang.setdefault(k, []).append(t)
    plain = plain_model(by_lang)
    model = langid.train(df.where(langid.in_training("doc_id")))
    assert sorted(model.langs) == sorted(vocabulary)
    for _, t, _ in rows[:60]:
        _, _, found = plain_verdict(plain, t)
        hits, total = model.hits(t)
        assert total == len(plain_grams(t)) and max(abs(h - found[k]) for k, h in zip(model.langs, hits, strict=True)) < 1e-6
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i] == k for i, k in held) >= 0.98 * len(held)


def test_more_than_eight_languages():
    import numpy as np

    texts = {f"l{i}": " ".join(f"{chr(97 + i)}{chr(98 + i)}{chr(100 + k)}w" for k in range(9)) for i in range(12)}
    grams = {k: np.unique(np.concatenate(list(langid._grams(t)))) for k, t in texts.items()}
    model = langid.build(list(texts), grams)
    assert all(model.predict(t)[0] == k for k, t in texts.items())


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    sizes = sorted((len(WORD.findall(r["text"] or "")) for r in docs.collect()))
    assert sorted(r["size"] for r in rows) == sizes
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and len(r["positions"]) == -(-r["taken"] // r["size"] if r["size"] else 0)
        assert r["positions"] == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
    assert abs(sum(v[0]["target"] for v in by.values()) - sum(sizes)) < 1
    names = sorted((k for k in by if k is not None)) + [None]
    level = set()
    for k, name in enumerate(names):
        v = by[name]
        assert v[0]["source_size"] == sum(r["size"] for r in v) and abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1
        if v[0]["target"] < 3 * v[0]["source_size"] - 1e-6:
            level.add(round(v[0]["target"] / (5, 2, 1)[k % 3], 3))
    assert len(level) == 1
    assert [tuple(r) for r in mixing.mix(docs).collect()] == [tuple(r) for r in rows]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_chat(spark):
    bad = "</s>[INST] ~0 <|end|> <|turn|>user<|text|> [/INST] <|next|>~"
    rows = [(1, 2, "user", bad), (1, 1, "system", None), (1, 3, "user", "again"), (1, 4, "assistant", bad), (1, 5, "assistant", "é😀"), (1, 5, "assistant", "é😀"), (None, 1, None, "x"), (2, None, "assistant", ""), (3, 1, "<|text|>", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.parse_chats(formatted).collect()}
    want = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert {k: [tuple(t) for t in r["turns"]] for k, r in got.items()} == want
    assert {k: r["loss_texts"] for k, r in got.items()} == {k: [t for role, t in v if role == "assistant"] for k, v in want.items()}
    assert got[1]["formatted"].count(chat.TURN) == 3
    assert chat.parse_chats(chat.format_chats(df.limit(0))).count() == 0


def test_secrets(spark):
    token = "aB3dE5gH7jK9mN1pQ3sT5uV7"
    texts = ["é token = \"0123456789abcdef0123\" end", "api_key:short password: abcdefghijkl", "AKIA" + "Z9" * 8, "x" * 50 + " deadbeefdeadbeef1 " + token, None, "", "token: password: abcdefghijkl", f"own {token}x7Yz here"]
    rows = [(i, t, "s0" if i % 2 else None) for i, t in enumerate(texts)] + [(20, texts[0], "s1"), (20, texts[0], "s1"), (None, texts[2], "s2")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("all", secrets.joined("spans")).withColumn("b", secrets.joined("base")).collect()
    pattern = re.compile(secrets.ASSIGN)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, _ in rows:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert by[i][0]["b"] == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
    assert len(got) == len(rows) and by[0][0]["n_example"] == 2 and by[3][0]["all"].endswith("opaque:69:93") and by[7][0]["n_live"] == 1


def test_secrets_of_many_repositories(spark):
    """One owner, but many repositories: an example, and no opaque span."""
    many, few = "aB3dE5gH7jK9mN1pQ3sT5uV7", "zY3dE5gH7jK9mN1pQ3sT5uV8"
    rows = [(i, f"see {many}", "s", f"r{i}") for i in range(30)] + [(100 + i, f"see {few} and {few}", "s", f"r{i % 2}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place string")
    got = {r["doc_id"]: (len(r["spans"]), r["n_live"], r["n_example"]) for r in secrets.scan(df, repo="place").collect()}
    assert got == {i: (0, 0, 1) if i < 100 else (2, 2, 0) for i, *_ in rows}
    alone = {r["doc_id"]: (len(r["spans"]), r["n_live"], r["n_example"]) for r in secrets.scan(df, repo=None).collect()}
    assert alone == {i: (1, 1, 0) if i < 100 else (2, 2, 0) for i, *_ in rows}


def test_secrets_in_odd_tables(spark):
    """An empty table, a very long text, clashing columns and a null id."""
    token = "AKIA" + "Z9" * 8
    long = ("word " * 200 + token + " ") * 500
    df = spark.createDataFrame([(1, long, "s", "x", 5, 3), (None, None, None, None, None, None), (2, token, "s", None, 1, 1)], "doc_id long, text string, source string, spans string, owners int, rk int")
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    size = len("word " * 200 + token + " ")
    assert [(s["start"], s["end"]) for s in got[1]["base"]] == [(k * size + 1000, k * size + 1000 + len(token)) for k in range(500)]
    assert got[None]["base"] == [] and got[2]["n_live"] == 1 and (got[2]["max_owners"], got[2]["max_repos"], got[None]["max_repos"]) == (1, 2, 0)
    assert secrets.scan(df.limit(0)).count() == 0


def test_chat_of_great_length(spark):
    """Twenty thousand turns and a text of millions of characters, beside clashing columns."""
    rows = [(1, k, ("user", "assistant", "assistant")[k % 3], f"~{k}", "f", 1) for k in range(20_000)] + [(2, 0, "assistant", "é<|end|>" * 300_000, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, blocks int").repartition(3)
    got = {r["conv_id"]: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [(r[2], r[3]) for r in rows[:-1]] and got[1]["loss_texts"] == [r[3] for r in rows[:-1] if r[2] == "assistant"]
    assert got[2]["loss_texts"] == [rows[-1][3]] and got[2]["turns"][0]["text"] == rows[-1][3]


def test_release(spark):
    import os

    from codelode.llm import common

    kept, gone = common.materialize(spark.range(3), "keep-this"), common.materialize(spark.range(3), "other")
    place = gone.inputFiles()[0].removeprefix("file://")
    common.release(spark, keep=("keep-",))
    assert kept.count() == 3 and not os.path.exists(place)
    common.release(spark)


def test_sharding(spark, docs):
    got = sharding.shard(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == docs.count()
    want = sorted((len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard(docs.limit(0)).count() == 0 and sharding.shard(docs.limit(3)).count() == 3


def test_sharding_against_plain_python(spark):
    """Labels after propagation equal those of the same rule in plain loops."""
    rows = [(i, f"t{i * i % 37}" if i % 3 else f"alone{i}", None) for i in range(500)] + [(1000 + i, "hot", None) for i in range(260)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    shards, slack, credits = 7, 0.1, 3
    nodes = df.selectExpr("doc_id", "unhex(md5(text)) g", "xxhash64(doc_id) h", "cast(pmod(xxhash64(doc_id), 7) as int) label")
    nodes = sharding.materialize(sharding.bucketed(nodes), "test")
    assert nodes.where("b2 > 0").count() == 0 or nodes.groupBy("g").agg(F.max("b2").alias("b")).where("b > 1").count() == 0
    got = {r["doc_id"]: r["label"] for r in sharding.propagate(nodes, shards).collect()}
    turn = {(bytes(r["g"]), r["s"]): r["t"] for r in nodes.select("g").distinct().crossJoin(spark.range(shards).selectExpr("cast(id as int) s")).selectExpr("g", "s", "xxhash64(g, s) t").collect()}
    here = [dict(r.asDict(), g=bytes(r["g"])) for r in nodes.collect()]
    cap = -int(-len(here) * (1 + slack) // shards)
    for _ in range(500):
        load = collections.Counter(r["label"] for r in here)
        seats = collections.Counter((r["g"], r["label"]) for r in here)
        queue = {}
        for r in here:
            own = {s: n for (g, s), n in seats.items() if g == r["g"]}
            open_ = [(n, turn[r["g"], s], s) for s, n in own.items() if load[s] < cap]
            if len(own) > 1 and open_:
                n, t, s = max(open_)
                mine = own[r["label"]]
                if s != r["label"] and (n > mine or n == mine and (t > turn[r["g"], r["label"]] or load[r["label"]] >= cap)):
                    queue.setdefault(s, []).append(r)
        if not queue:
            break
        for q in queue.values():
            q.sort(key=lambda r: (r["b1"], r["b2"], r["g"], r["doc_id"]))
        room, gone = {s: max(0, cap - load[s]) for s in range(shards)}, collections.Counter()
        for _ in range(credits):
            gone = collections.Counter(r["label"] for s, q in queue.items() for r in q[: max(0, cap - load[s] + gone[s])])
        moves = [(r, s) for s, q in queue.items() for r in q[: max(0, cap - load[s] + gone[s])]]
        for r, s in moves:
            r["label"] = s
    assert got == {r["doc_id"]: r["label"] for r in here} and room


def test_sharding_deals_a_hot_group_over_buckets(spark):
    df = spark.createDataFrame([(i, "hot" if i < 4000 else f"t{i}") for i in range(6000)], "doc_id long, text string")
    nodes = sharding.bucketed(df.selectExpr("doc_id", "unhex(md5(text)) g", "xxhash64(doc_id) h"))
    sizes = [r["count"] for r in nodes.where("alone = 0").groupBy("b1", "b2").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 400 and nodes.where("alone = 1").agg(F.max("b2")).first()[0] == 0
    got = sharding.shard(df).collect()
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len({(r["shard"], r["slot"]) for r in got}) == 6000


def test_sharding_rounds_work_on_groups_in_question(spark, monkeypatch):
    """After the first round, rows of groups that stand in one shard aren't joined and written again, and none is lost."""
    df = spark.createDataFrame([(i, "hot" if i < 300 else f"t{i // 2}" if i < 400 else f"alone{i}") for i in range(2400)], "doc_id long, text string")
    nodes = df.selectExpr("doc_id", "unhex(md5(text)) g", "xxhash64(doc_id) h", "cast(pmod(xxhash64(doc_id), 24) as int) label")
    nodes, write, joined = sharding.materialize(sharding.bucketed(nodes), "test"), sharding.materialize, []

    def counting(rows, label):
        out = write(rows, label)
        if label == "shard-asked":
            joined.append(out.count())
        return out

    monkeypatch.setattr(sharding, "materialize", counting)
    monkeypatch.setattr(sharding, "ASIDE", 2, raising=False)
    got = [r["doc_id"] for r in sharding.propagate(nodes, 24).collect()]
    assert sorted(got) == list(range(2400))
    assert len(joined) > 3 and joined[0] == 2400 and max(joined[1:]) <= 400


def test_sharding_keeps_groups(spark):
    df = spark.createDataFrame([(i, f"t{i // 4}" if i < 400 else f"alone{i}") for i in range(2400)], "doc_id long, text string").coalesce(2)
    shards = {}
    for r in sharding.shard(df).join(df, "doc_id").where("doc_id < 400").collect():
        shards.setdefault(r["text"], set()).add(r["shard"])
    assert sum(len(s) == 1 for s in shards.values()) >= 95


def test_sharding_where_all_rows_have_copies(spark):
    """Rounds go on until they settle: groups of ten, from independent starts, come whole."""
    df = spark.createDataFrame([(i, f"t{i // 10}") for i in range(24_000)], "doc_id long, text string").coalesce(2)
    shards = {}
    for r in sharding.shard(df).collect():
        shards.setdefault(r["doc_id"] // 10, set()).add(r["shard"])
    # the last pass, which makes counts even, cuts a group at most at each end of what it moves
    assert sum(len(s) > 1 for s in shards.values()) <= 2 * 24
    nodes = sharding.materialize(df.selectExpr("doc_id", "unhex(md5(text)) g", "cast(pmod(hash(text), 64) as int) b1", "0 b2", "cast(pmod(xxhash64(doc_id), 24) as int) label"), "test")
    with pytest.raises(RuntimeError):
        sharding.propagate(nodes, 24, max_rounds=1)
    settled = sharding.propagate(nodes, 24)
    assert settled.count() == 24_000 and settled.groupBy("g").agg(F.countDistinct("label").alias("n")).where("n > 1").count() == 0
    assert max(r["count"] for r in settled.groupBy("label").count().collect()) <= 1100


def plain_feature(payload):
    """The feature by plain loops: means of cells of 24 samples by an eighth of the rows, against their mean."""
    rows = [payload[k : k + 192] for k in range(0, len(payload), 192)]
    edges = [int(k * len(rows) / 8) for k in range(9)]
    cells = []
    for a, b in zip(edges, edges[1:], strict=False):
        for c in range(8):
            own = [x for r in rows[a : max(b, a + 1)] for x in r[24 * c : 24 * c + 24]]
            cells.append(sum(own) / len(own))
    mean = sum(cells) / 64
    bits = "".join(str(int(c > mean + 1e-9)) for c in cells)
    return f"{int(bits, 2):016x}", any(abs(c - mean) < 1e-6 for c in cells)


def test_media(spark, docs):
    from codelode.llm import webp

    stored = media.store_texts(docs).persist()
    files = {}
    for r in stored.collect():
        files.setdefault(r["doc_id"], []).append(bytes(r["media"]))
    got = sorted(media.describe(stored).collect(), key=str)
    want = []
    for r in docs.collect():
        data = (r["text"] or "").encode()
        full = media.padded(data)
        want.append((r["doc_id"], len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]), full))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted((w[:5] for w in want), key=str)
    payloads = {w[3]: w[5] for w in want}
    for r in got:
        full = payloads[r["payload_sha256"]]
        own = [m for m in files[r["doc_id"]] if webp.load(m) == full]
        assert r["media_bytes"] == len(own[0]) and r["media_sha256"] == hashlib.sha256(own[0]).hexdigest()
        feature, tie = plain_feature(full)
        assert tie or r["feature"] == feature
    assert media.describe(media.store_texts(docs.limit(0))).count() == 0


PAGES = [(5, "http://a/x y", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (4, None, None), (None, "http://c\r\nX: 1", "z"), (9, "http://d", ""), (10, "http://e", "big" * 50_000)]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    rows = warc.read_warc(spark, str(tmp_path / "w"), checks=True).collect()
    assert len(rows) == len(PAGES)
    by = {(r["record_id"], r["record_type"]): r for r in rows}
    assert by[("urn:page:5", "revisit")]["refers_to"] == "urn:page:3" and by[("urn:page:9", "revisit")]["refers_to"] == "urn:page:4"
    assert bytes(by[("urn:page:10", "response")]["payload"]) == b"big" * 50_000
    digest = base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert by[("urn:page:5", "revisit")]["payload_digest"] == digest == by[("urn:page:3", "response")]["payload_sha1"]
    assert by[("urn:page:5", "revisit")]["http_length"] == len("<p>é</p>".encode())
    # the archives are what any gzip reader expects
    plain = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").iterdir()) if not f.name.startswith("."))
    assert plain.count(b"WARC/1.1\r\n") == len(PAGES) and b"X: 1\r\n" not in plain
    # and plain or foreign gzip archives are read as well
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.warc").write_bytes(plain)
    (tmp_path / "p/b.warc.gz").write_bytes(gzip.compress(plain[: plain.index(b"WARC/1.1", 5)]))
    assert warc.read_warc(spark, str(tmp_path / "p")).count() == len(PAGES) + 1
    small = warc.round_trip(pages, least_bytes=100)
    assert small.where("record_type = 'revisit'").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_predicates(spark, tmp_path):
    warc.write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string"), str(tmp_path / "w"))
    df = warc.read_warc(spark, str(tmp_path / "w")).where("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [r["record_id"] for r in df.collect()] == ["urn:page:5"]
    reader = warc.WarcReader({"path": str(tmp_path / "w")})
    from pyspark.sql.datasource import EqualTo, IsNull

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), IsNull(("payload",))]))
    assert len(left) == 1 and reader.tests == [("record_type", "in", ("revisit",))]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2


def plain_record(kind, n, content, end=b"\r\n"):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:x:%d>" % n, b"Content-Length: %d" % len(content)]
    if kind == b"response":
        lines.append(b"Content-Type: application/http; msgtype=response")
    return end.join(lines) + end * 2 + content + end * 2


def test_warc_of_others(spark, tmp_path):
    """Several records a member, members that end in the midst of one, blank lines, LF line ends, records without HTTP."""
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + b"\r\n\r\nWARC/1.0 p" * 20_000
    made = [plain_record(b"warcinfo", 0, b"a: b"), plain_record(b"response", 1, body), plain_record(b"metadata", 2, b""), plain_record(b"response", 3, b"no blank line"), plain_record(b"response", 4, b"HTTP/1.1 200\n\nlf")]
    whole = b"".join(made)
    files = {
        "members.warc.gz": b"".join(map(gzip.compress, made)),
        "one.warc.gz": gzip.compress(whole),
        "cut.warc.gz": gzip.compress(whole[:150]) + gzip.compress(whole[150:90_000]) + gzip.compress(whole[90_000:]),
        "ours.warc.gz": b"".join(map(warc.member, made)),
        "ours_two.warc.gz": warc.member(made[0] + made[1]) + warc.member(b"".join(made[2:])),
        "plain.warc": whole,
        "blank.warc": b"\r\n" + b"\r\n\n".join(made) + b"\r\n",
        "lf.warc": b"".join(plain_record(k, n, c, b"\n") for k, n, c in ((b"warcinfo", 0, b"a: b"), (b"response", 1, body), (b"metadata", 2, b""), (b"response", 3, b"no blank line"), (b"response", 4, b"HTTP/1.1 200\n\nlf"))),
        "empty.warc.gz": b"",
        "empty.warc": b"\r\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        rows = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / name), checks=True).collect()}
        if name.startswith("empty"):
            assert not rows
            continue
        assert sorted(rows) == [f"urn:x:{n}" for n in range(5)], name
        assert bytes(rows["urn:x:1"]["payload"]) == body[body.index(b"\r\n\r\n") + 4 :] and bytes(rows["urn:x:0"]["payload"]) == b"a: b", name
        assert [bytes(rows[f"urn:x:{n}"]["payload"]) for n in (2, 3, 4)] == [b"", b"", b"lf"], name
        for payload in (True, False):
            some = warc.read_warc(spark, str(tmp_path / name), payload=payload).where("record_type <> 'response'")
            only = warc.read_warc(spark, str(tmp_path / name), payload=payload).where("record_type = 'response'")
            assert (some.count(), only.count()) == (2, 3), name


@pytest.mark.parametrize("name, data", [
    ("a.warc", b"no record at all\r\n\r\n"), ("b.warc", plain_record(b"x", 1, b"abc")[:-6]), ("c.warc", b"WARC/1.0\r\nWARC-Type: x\r\n"), ("d.warc", b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"),
    ("e.warc.gz", gzip.compress(plain_record(b"x", 1, b"abc" * 999))[:-30]), ("f.warc.gz", b"not gzip"), ("g.warc.gz", gzip.compress(plain_record(b"x", 1, b"abc")) + b"rest"), ("h.warc", plain_record(b"x", 1, b"abc") + b"more"),
])
def test_malformed_warc(tmp_path, name, data):
    """Raised with the name of the file, never passed over."""
    (tmp_path / name).write_bytes(data)
    reader = warc.WarcReader({"path": str(tmp_path / name)})
    with pytest.raises(ValueError, match=name):
        list(reader.read(reader.partitions()[0]))


def test_unwanted_payloads_are_not_inflated(tmp_path):
    """Of a member that isn't wanted only the first KB is inflated and the next piece of the file read."""

    class Counted:
        def __init__(self, f):
            self.f, self.n = f, 0

        def size(self):
            return self.f.seek(0, 2)

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            data = self.f.read(n)
            self.n += len(data)
            return data

    import os

    big = warc.record("response", "r", "http://a", None, "X", 5_000_000, os.urandom(5_000_000), "d")
    (tmp_path / "w").write_bytes(warc.member(big) * 3 + warc.member(plain_record(b"revisit", 1, b"")))
    with (tmp_path / "w").open("rb") as f:
        counted = Counted(f)
        assert [h["warc-type"] for h, _, _ in warc.records(counted, True, lambda h: h["warc-type"] == "revisit", True)] == ["revisit"]
        assert counted.n < 4 * (warc.PIECE + 24)
        counted.n = 0
        assert len(list(warc.records(counted, True, lambda h: True, False))) == 4 and counted.n < 4 * (warc.PIECE + 24)


def test_warc_with_clashing_columns(spark):
    rows = [(*r, "x", 5, None) for r in PAGES]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, id int, record_type string")
    assert warc.round_trip(df).count() == len(PAGES)


def test_thin_queries(spark):
    for name, f in queries.QUERIES.items():
        assert f(spark, SF).count() > 0, name


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, kept[-1], SF)
        assert out.columns == cp.COLUMNS, name
        kept.append(cp.materialize(out, "test"))
    clean, unique, safe, mixed = ({r["doc_id"] for r in k.select("doc_id").collect()} for k in kept[1:])
    assert clean == {r["doc_id"] for r in docs.where("text rlike '[A-Za-z]'").collect()}
    dup = neardup.near_duplicates(kept[1]).where("kept").select("doc_id").collect()
    assert unique == {r["doc_id"] for r in dup} and kept[2].count() == len(unique)
    bench = [" ".join(re.findall(r"[^\W_]+", r["text"].lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in kept[2].collect() if any(b in " ".join(re.findall(r"[^\W_]+", r["text"].lower())) for b in bench)}
    assert safe == unique - leaks and mixed <= safe
    plan = {r["doc_id"]: len(r["positions"]) for r in mixing.mix(kept[3]).collect()}
    counts = {r["doc_id"]: r["count"] for r in kept[4].groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in plan.items() if v}
    assert cp.STAGES[4][1](spark, kept[4], SF).count() == kept[4].count()


def test_decontamination_of_excerpts(spark):
    """Verbatim and edited excerpts of items, at any offset, among other words."""
    import random

    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    items = {n: " ".join(rng.choices(vocabulary, k=n))[:n].replace(" ", "x", 1).strip() for n in (120, 160, 233, 300)}
    fill = lambda: " ".join(rng.choices(vocabulary, k=15))
    rows = []
    for n, item in items.items():
        for share in (0.9, 0.6, 0.5):
            size = int(share * len(item))
            if size >= 83:
                for at in range(0, len(item) - size + 1, 9):
                    part = item[at : at + size]
                    rows.append((n, f"{fill()} {part} {fill()}"))
                    rows.append((n, f"{fill()} {''.join(c if k % 15 != 7 else 'q' for k, c in enumerate(part))} {fill()}"))
    clean = [(None, f"{fill()} {item[10:50]} {fill()}") for item in items.values()] + [(None, fill()) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows + clean)], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in decontam.contaminated(df, bench).collect()}
    assert got == {i: n for i, (n, _) in enumerate(rows)}
    # evenly edited items get all of their edits
    assert decontam.probes([(1, items[160])]).budget[0] == 16


def test_edits_at_the_bound(spark):
    """A tenth of an item's characters, rounded down, may differ, at every length; one more may not."""
    import random

    rng = random.Random(9)
    fill = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    items, rows, want = {}, [], {}
    for m in range(24, 161):
        item = "".join(rng.choice("ijklmnopqrstuvwxyz") for _ in range(m))
        items[m] = item
        for over in (0, 1):
            for _ in range(3):
                places = rng.sample(range(m), m // 10 + over)
                text = list(item)
                for k in places:
                    text[k] = rng.choice("0123456789")
                rows.append((len(rows), f"{fill(50)} {''.join(text)} {fill(50)}"))
                want[rows[-1][0]] = m if not over else None
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {}
    for r in decontam.contaminated(df, bench).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    for i, m in want.items():
        if m is not None:
            assert got.get(i) == {m}, (i, m)
    # one edit more: only where a short probe inside the item has fewer of them
    for i, (_, text) in enumerate(rows):
        if want[i] is None:
            m = len(text.strip()) if i not in got else next(iter(got[i]))
            assert i not in got or m > 56


def test_hits_in_pieces(monkeypatch):
    """Counts of shared grams are the same whatever the size of a piece."""
    import random

    rng = random.Random(2)
    items = [(i, "".join(rng.choice("ab ") for _ in range(120))) for i in range(20)]
    chars = decontam.folded(" ".join(t for _, t in items) + "".join(rng.choice("ab ") for _ in range(3000)), True)[0]
    p = decontam.probes(items)
    whole = decontam.regions(p, chars)
    monkeypatch.setattr(decontam, "HITS", 50)
    assert whole and sorted(decontam.regions(p, chars)) == sorted(whole)


def test_short_items_are_searched_exactly(spark):
    bench = spark.createDataFrame([(1, "Kurz"), (2, "two  words!"), (3, "...")], "item_id long, text string")
    texts = ["ein kurz-er Satz", "kurzer", "KURZ", "of two Words.", "two or words", "", "kurz two words kurz"]
    got = decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench)
    assert sorted((r["doc_id"], r["item_id"], r["start"], r["end"], r["probes"], r["edits"]) for r in got.collect()) == [(0, 1, 4, 8, 1, 0), (2, 1, 0, 4, 1, 0), (3, 2, 3, 12, 1, 0), (6, 1, 0, 19, 2, 0), (6, 2, 5, 14, 1, 0)]


def plain_folded(text):
    out, before = [], True
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        if c.isalnum():
            out.append(low)
            before = False
        elif not before:
            out.append(" ")
            before = True
    return "".join(out)


def plain_probes(item):
    """Windows of 160 by 80 and of 56 by 28 characters, the last at the end; a shorter item whole."""
    out = set()
    for size, stride in ((160, 80), (56, 28)):
        if len(item) <= size:
            out.add(item)
        else:
            out |= {item[a : a + size] for a in range(0, len(item) - size, stride)} | {item[-size:]}
    return out


def test_decontamination_against_brute_force(spark):
    """The query over whole tables: every (document, item) by plain edit distances of all probes against all texts."""
    import numpy as np

    docs = [(r["doc_id"], plain_folded(r["text"] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], plain_folded(r["text"]).strip()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gap = "\uffff" * 161
    whole = gap.join(["", *(t for _, t in docs), ""])
    chars, starts, at = np.array(list(map(ord, whole)), np.uint32), [], 161
    for _, t in docs:
        starts.append(at)
        at += len(t) + 161
    want = set()
    for item, text in items:
        for probe in plain_probes(text):
            most = len(probe) // 10
            cost = np.zeros(len(chars) + 1, np.int16)
            live = np.arange(len(chars) + 1)
            # a stretch within k edits of a probe holds one of k + 1 parts of it unchanged: look around those only
            parts = np.linspace(0, len(probe), most + 2).astype(int)
            near = set()
            for a, b in zip(parts, parts[1:], strict=False):
                x = whole.find(probe[a:b])
                while x >= 0:
                    near.add((x - a) // 64)
                    x = whole.find(probe[a:b], x + 1)
            for block in near:
                low = max(0, block * 64 - most - 1)
                own = chars[low : block * 64 + 64 + len(probe) + most + 1]
                cost, live = np.zeros(len(own) + 1, np.int64), np.arange(len(own) + 1)
                for j, c in enumerate(probe):
                    new = np.append(j + 1, np.minimum(cost[:-1] + (own != ord(c)), cost[1:] + 1))
                    cost = np.minimum.accumulate(new - live) + live
                if cost.min() <= most:
                    end = low + int(cost.argmin())
                    want.add((docs[int(np.searchsorted(starts, max(end - 1, 0), "right")) - 1][0], item))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontam(spark, SF).collect()}
    assert got == want and want


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, a very long text, clashing columns, an empty table: stage by stage."""
    import corpus_pipeline as cp

    base = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "k") for r in base]
    long = " ".join(r["text"] for r in base) * 3
    rows += [(None, None, None, None, None, None, None), (7001, "", "en", None, 0, 1, "k"), (7002, None, "en", "s", None, 2, None), (None, base[0]["text"], None, "s", 1, 1, "k")]
    rows += [(7003, long, "en", None, 1, 1, "k")] + [(7004, base[5]["text"] + " and so on", "en", "s", 1, 1, "k")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id long, _k string")
    here = docs
    for k, (name, stage) in enumerate(cp.STAGES):
        before, here = here, cp.materialize(stage(spark, here, SF), "test")
        if k < 4:
            assert here.columns == cp.COLUMNS, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        got = collections.Counter((r["doc_id"], r["text"]) for r in here.collect()) if k < 4 else None
        if name == "language":
            assert got[None, None] == got[7001, ""] == got[7002, None] == 0 and got[None, base[0]["text"]] == 1 and got[7003, long] == 1 and got[7004, rows[-1][1]] == 2
        if name == "dedup":
            assert got[None, base[0]["text"]] == 1 and got[7003, long] == 1 and sum(n for (i, _), n in got.items() if i == 7004) <= 1
        if name == "shard":
            assert here.count() == before.count()


def test_pipeline_rows_that_share_an_id(spark):
    import corpus_pipeline as cp

    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r["text"]) > 100)
    words_of = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    a, near, b = words_of("a", 60), words_of("a", 59) + " z", words_of("b", 60)
    rows = [(2, a), (5, a), (5, b), (5, b), (6, near), (6, "other words of its own"), (None, a), (7, item), (7, "clean words here")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    unique = cp.materialize(cp.dedup(spark, df, SF), "test")
    assert sorted(((r["doc_id"], r["text"]) for r in unique.collect()), key=str) == sorted([(2, a), (5, b), (6, rows[5][1]), (None, a), (7, item), (7, rows[8][1])], key=str)
    safe = cp.decontaminate(spark, unique, SF)
    assert safe.columns == cp.COLUMNS and sorted(r["text"] for r in safe.collect() if r["doc_id"] == 7) == [rows[8][1]]
