"""Training-data operators against brute force, round trips, held-out labels and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows_of

from quillspark.llm import decontamination, language_id, ngram_jaccard, packing, pii, quality, queries, secrets, token_counts, toxicity, warc

COLS = "doc_id long, text string, lang string, source string, n_chars long, key int, cls int, th int"
TOXIC = "idiot moron stupid scum".split()


def frame(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", None if i % 3 else "s", len(t or ""), 1, 2, 3) for i, t in enumerate(texts)], COLS)


EDGE = [None, "", " \n\t ", "one", "a b c d", "x " * 30_000, "same text here for the copies to be", "same text here for the copies to be", "É" * 50]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(name, spark, duck):
    assert rows_of(queries.QUERIES[name](spark, SMALL).toPandas()) == rows_of(duck.execute(queries.SQL[name]).df())


def brute_components(texts):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, comp = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return [len(s) for s in sets], comp


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TILE", 8)
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(60)]
    texts = list(EDGE)
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        texts.append(" ".join(w))
    n, comp = brute_components(texts)
    got = {r.doc_id: r for r in ngram_jaccard.ngram_jaccard_components(frame(spark, texts)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == n and [got[i].component_id for i in range(len(texts))] == comp
    kept = ngram_jaccard.without_near_duplicates(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp)) and kept.columns == frame(spark, []).columns


def test_decontamination_edges_and_proximity(spark):
    item = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"
    docs = frame(spark, [*EDGE, f"x {item} y", f"{item} and {item}", "A b"])
    bench = spark.createDataFrame([(1, item), (2, "a, B!"), (3, None), (None, item)], "item_id int, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.decontaminate(docs, bench).collect()}
    assert got[9] == (13, 11, 1, True) and got[10] == (23, 22, 1, True) and got[11] == (2, 2, 1, True) and got[0] == (0, 0, 0, False)
    assert got[4] == (4, 2, 1, True)
    none = decontamination.decontaminate(docs, bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == docs.count()
    keyed = decontamination.keyed(docs)
    wins, _, terms = decontamination.phrase_windows(bench)
    index = decontamination.postings(keyed, terms)
    asked = terms.where("term in ('q1', 'q3')").select(F.lit(1).alias("qid"), "tid")
    assert decontamination.proximity_matches(index, asked, 2).count() == 3
    assert decontamination.proximity_matches(index, asked, 1).count() == 0


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*EDGE, "Ünïcode, words. don't stop<|endoftext|> x\x1cy  z", "The the THE, the."]
    got = packing.pack_documents(frame(spark, texts), path).toPandas()
    tok = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 4096)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + 4096].tobytes()) for a in own.start]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    lengths = token_counts.token_counts(frame(spark, texts), path).toPandas()
    size = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for r in lengths.itertuples():
        assert r.truncated_total == sum(min(s, r.context_limit) for s in size) and r.docs_at_least == sum(s >= r.context_limit for s in size)


def test_sum_of_squares_is_near_the_bound():
    sizes = np.sort(np.random.default_rng(1).integers(1, 3000, 5000))[::-1]
    where, offset, bins = packing.sum_of_squares(sizes, 4096)
    assert bins <= 1.01 * -(-sizes.sum() // 4096) + 2 and (np.bincount(where, sizes) <= 4096).all()


def test_warc_rejects_magic_in_payloads(spark, tmp_path):
    fake = warc.record_text(99, "u", "inner", "X", None, False, 5) + "\r\n\r\n"
    pages = [(1, "u", "<p>é</p>", 0), (2, "u", fake * 3, 0), (3, None, None, 0), (4, "u", "<p>é</p>", 0), (5, "u", "", 0), (6, "u", "WARC/1.1\r\n", 0)]
    path = f"file://{tmp_path}/a"
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string, size int"), path)
    for segment in (warc.SEGMENT, 700):
        got = {r.page_id: r for r in warc.read_warc(spark, path, segment).collect()}
        assert sorted(got) == [1, 2, 3, 4, 5, 6]
        assert got[4].record_type == "revisit" and got[4].refers_to == 1 and got[5].refers_to == 3 and got[3].payload_bytes == 0
        assert got[4].payload_digest == got[1].payload_digest == warc.base32_sha1("<p>é</p>".encode()) and got[4].payload_bytes == 9


def test_warc_chains_cross_segments(spark, tmp_path):
    pages = spark.range(120).selectExpr("id as page_id", "'u' as url", "repeat(concat('x', id), 20 + id % 7) as html").coalesce(1)
    warc.write_warc(pages, f"file://{tmp_path}/a")
    for segment in (900, 5000, 40_000):
        assert sorted(r.page_id for r in warc.read_warc(spark, f"file://{tmp_path}/a", segment).collect()) == list(range(120))


def test_toxicity(spark):
    automaton = toxicity.TrieAutomaton(["idiot", "moron", "sad", "lowei*"])
    assert [automaton.match(w) for w in ("idiot", "idlot", "idot", "iidiot", "idxxot", "said", "sad", "loweichen")] == [(0, 0), (1, 0), (1, 0), (1, 0), None, None, (0, 2), (0, 3)]
    rng = random.Random(5)
    texts, marks = [], []
    for i in range(400):
        w = [f"w{rng.randrange(200)}" for _ in range(40)]
        if i % 4 == 0:
            w[rng.randrange(40)] = rng.choice(TOXIC)
        texts.append(" ".join(w))
        marks.append((i, int(i % 4 == 0)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score_toxicity(frame(spark, [*texts, None, ""]), labels).toPandas().set_index("doc_id")
    held = [(i, y) for i, y in marks if got.held_out[i]]
    assert np.mean([got.predicted[i] == y for i, y in held]) > 0.95 and all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(402))
    assert got.score.between(0, 1).all() and got.predicted[400] == 0


def test_secrets_match_brute_force(spark):
    texts = [*EDGE, 'api-key api_key = "abcdef123" PASSWORD:short token=AbCdEf99', "AKIA" + "A1B2" * 5 + " " + "0af3" * 10, "é password='x1y2z3w4' deadbeef"]
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in secrets.scan_secrets(frame(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))


def test_forward_backward_is_exact_and_edges(spark):
    model = language_id.Crf(["a", "b", "c"], {})
    rng = np.random.default_rng(0)
    model.trans, model.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    e, first = rng.normal(size=(200, 3)).astype(np.float32), np.zeros(200, bool)
    first[[0, 40, 41, 130]] = True
    got = model.posteriors(e, first, blocks=7)
    for lo, hi in ((0, 40), (40, 41), (41, 130), (130, 200)):
        x, t = np.exp(e[lo:hi].astype(float)), np.exp(model.trans)
        a = [np.exp(model.start) * x[0]]
        for k in range(1, hi - lo):
            a.append((a[-1] @ t) * x[k] / a[-1].sum())
        b = [np.ones(3)]
        for k in range(hi - lo - 2, -1, -1):
            b.insert(0, t @ (x[k + 1] * b[0]) / b[0].sum())
        want = np.array(a) * np.array(b)
        assert np.allclose(got[lo:hi], want / want.sum(1, keepdims=True), atol=1e-4)
    out = {r.doc_id: r for r in language_id.identify_languages(frame(spark, [*EDGE, "the and of"])).collect()}
    assert out[0].lang_pred == out[1].lang_pred == "und" and out[9].lang_pred == "en"
    assert language_id.identify_languages(frame(spark, ["x"]).withColumn("lang", F.lit(None).cast("string"))).first().lang_pred == "und"


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id.Crf, "fit", lambda self, spans: self)
    docs = frame(spark, ["some words"] * 2050).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 205))
    assert len(language_id.fit_crf(docs).labels) == 205


def luhn(s):
    d = [int(c) for c in s[::-1] if c.isdigit()]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark):
    texts = [*EDGE, "mail a.b1@x.org card 4111 1111 1111 1111 ip 10.0.0.1 on 2023-02-28", "again 4111 1111 1111 1111, bad 4111 1111 1111 1112, +1 (212) 555-0123, 2023-02-30", "DE89370400440532013000 and 123-45-6789"]
    docs = frame(spark, texts)
    out = {r.doc_id: r for r in pii.pseudonymize(docs, "k").collect()}
    assert out[0].text is None and all(out[i].text == texts[i] for i in range(1, 9))
    a, b, c = out[9].text, out[10].text, out[11].text
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", a)[0]
    assert card in b and card != "4111 1111 1111 1111" and luhn(card) and "4111 1111 1111 1112" in b and "2023-02-30" in b
    assert re.search(r"[a-z]\.[a-z]\d@x\.org", a) and "a.b1@" not in a and "10.0.0.1 " not in a and "2023-02-28" not in a
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", b) and "555-0123" not in b and out[9].n_pii == 4
    iban = re.search(r"DE\d{20}", c)[0]
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000" and "123-45-6789" not in c
    values = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("v"))
    assert values.select(pii.feistel(F.col("v"), "k", "t")).distinct().count() == 3000


BESIDE = [
    ("4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"], {"card": 1}),
    ("4111 1111 1111 1111 123", ["4111 1111 1111 1111"], {"card": 1}),
    ("4111-1111-1111-1111-12", ["4111-1111-1111-1111"], {"card": 1}),
    ("pay 2024 4111 1111 1111 1111", ["4111 1111 1111 1111"], {"card": 1}),
    ("2025 1234 5678 1234 5670 99", ["1234 5678 1234 5670"], {"card": 1}),
    ("4111 1111 1111 1111 5 5500 0000 0000 0004", ["4111 1111 1111 1111", "5500 0000 0000 0004"], {"card": 2}),
    ("4111 1111 1111 1111 192.168.0.1", ["4111 1111 1111 1111", "192.168.0.1"], {"card": 1, "ip": 1}),
    ("7 123-45-6789 4111 1111 1111 1111", ["123-45-6789", "4111 1111 1111 1111"], {"card": 1, "ssn": 1}),
    ("+1 415 555 2671 4111 1111 1111 1111", ["415 555 2671", "4111 1111 1111 1111"], {"phone": 1, "card": 1}),
    ("+1 41 55 26 71 4111 1111 1111 1111", ["41 55 26 71", "4111 1111 1111 1111"], {"phone": 1, "card": 1}),
    ("+1 415 555 2671 7070 3131", ["415 555 2671"], {"phone": 1}),
    ("DE89 3704 0044 0532 0130 00", ["3704 0044 0532 0130 00"], {"iban": 1}),
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF Please", ["3704 0044 0532 0130 00"], {"iban": 1}),
    ("AB12 DE89 3704 0044 0532 0130 00", ["3704 0044 0532 0130 00"], {"iban": 1}),
    ("DE89 4111 1111 1111 1111", ["4111 1111 1111 1111"], {"card": 1}),
]


def test_pseudonyms_beside_other_digits(spark):
    out = {r.doc_id: r for r in pii.pseudonymize(frame(spark, [text for text, _, _ in BESIDE]), "k").collect()}
    for i, (text, hidden, kinds) in enumerate(BESIDE):
        r = out[i]
        assert all(h not in r.text for h in hidden) and ("ip" in kinds or len(r.text) == len(text)), text
        assert {k: r[f"n_{k}"] for k in pii.COUNTED if r[f"n_{k}"]} == kinds, (text, r.text)
        if kinds == {"card": 1}:
            at, end = text.index(hidden[0]), text.index(hidden[0]) + len(hidden[0])
            assert luhn(r.text[at:end]) and r.text[:at] + r.text[end:] == text[:at] + text[end:], text


def test_empty_tables(spark):
    import public_tokenizers

    docs, path = frame(spark, []), public_tokenizers.path("word_bpe_49k.json")
    bench = spark.createDataFrame([], "item_id int, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        ngram_jaccard.ngram_jaccard_components(docs), decontamination.decontaminate(docs, bench), token_counts.token_counts(docs, path), quality.quality_rules(docs), packing.pack_documents(docs, path),
        warc.warc_round_trip(pages), toxicity.score_toxicity(docs, labels), secrets.scan_secrets(docs), language_id.identify_languages(docs), pii.pseudonymize(docs, "k"),
    ):
        assert out.count() == 0


def test_verdicts_of_large_and_small_hosts(spark):
    rng = random.Random(5)
    hosts = ["big"] * 200 + [None] * 60 + [f"h{i % 30}" for i in range(140)]
    docs = [(i, h, rng.randrange(4)) for i, h in enumerate(hosts)]
    counted = spark.createDataFrame(docs, "doc_id long, host string, n_failed int")
    verdicts = quality.host_verdicts(counted)
    want = {r.host: (r.host_rate, r.host_strict) for r in verdicts.collect()}
    # no host, only the two largest, and every host broadcast
    for hot_hosts in (0, 10, 10**6):
        got = {r.doc_id: (r.host_rate, r.host_strict) for r in quality.with_verdicts(counted, verdicts, hot_hosts).collect()}
        assert got == {i: want[h] for i, h, _ in docs}


def test_quality_edges(spark):
    got = {r.doc_id: r for r in quality.quality_rules(frame(spark, EDGE)).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept and got[5].n_repeat_words == 30_000 and len(got) == len(EDGE)


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    _, comp = brute_components([r.text for r in docs.orderBy("doc_id").collect()])
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    bad = {r.doc_id for r in decontamination.decontaminate(docs, bench).where("contaminated").collect()}
    langs = {r.doc_id for r in language_id.identify_languages(docs).where("lang_pred <> 'und' and score >= 0.3").collect()}
    ids = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").collect()]
    want = {ids[c] for c in set(comp)} - bad
    assert set(out.doc_id) == {d for d in want if d in langs}


def test_unlabelled_documents_stay(spark):
    docs = frame(spark, [None, "", "12 !", "clean text", "más"]).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in language_id.with_known_language(docs).collect()} == {3, 4}


def test_rejection_scales_with_the_languages(spark, monkeypatch):
    docs = frame(spark, ["some words"])
    monkeypatch.setattr(language_id, "_predict", lambda model: lambda batches: (b.select(["doc_id", "held_out"]).append_column("lang_pred", ["l1"]).append_column("score", [0.2]) for b in batches))
    assert [language_id.with_known_language(docs, model=language_id.Crf([f"l{i}" for i in range(n)], {})).count() for n in (4, 8)] == [0, 1]


def test_warc_paths_agree(spark, tmp_path):
    pages = [(i, "u", ["same", "twin", f"own {i}" * 50, None][i % 4], 1, "x") for i in range(60)] + [(None, None, "same", 1, "x"), (None, "u", "alone", 1, "x"), (7, "u", "own 7", 1, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, size int, digest string")
    got = []
    for name, rows in (("few", 1000), ("many", 0)):
        warc.write_warc(df, f"file://{tmp_path}/{name}", broadcast_rows=rows, file_bytes=4000)
        got.append(sorted(map(str, warc.read_warc(spark, f"file://{tmp_path}/{name}", 3000).collect())))
        assert max(f.stat().st_size for f in (tmp_path / name).glob("*.txt")) < 5500
    assert got[0] == got[1] and len(got[0]) == len(pages)
    warc.write_warc(df, f"file://{tmp_path}/least", least_bytes=5)
    kinds = {r.page_id: r.record_type for r in warc.read_warc(spark, f"file://{tmp_path}/least").collect()}
    assert set(kinds.values()) == {"response"}


def python_feistel(value, key, kind):
    """The network over characters, written again in plain Python."""

    def turned(c, number, least=0):
        for low, radix in (("0", 10), ("a", 26), ("A", 26)):
            if ord(low) <= ord(c) < ord(low) + radix:
                return chr(ord(low) + (ord(c) - ord(low) + number % (radix - least) + least) % radix)
        return c

    def digest(step, half):
        return hashlib.sha256(f"{key}|{kind}|{step}|{half}".encode()).hexdigest()

    if len(value) == 1:
        return turned(value, int(digest(0, "")[:8], 16), 1)
    a, b = value[: -(-len(value) // 2)], value[-(-len(value) // 2) :]
    for r in range(1, 9):
        h = digest(r, b)
        a, b = b, "".join(turned(c, int(h[4 * (i % 16) : 4 * (i % 16) + 4], 16)) for i, c in enumerate(a))
    return a + b


def python_pair(a, b, sides, key, kind):
    for r in range(1, 9):
        h = int(hashlib.sha256(f"{key}|{kind}|{r}|{b if r % 2 else a}".encode()).hexdigest()[:12], 16)
        a, b = ((a + h) % sides[0], b) if r % 2 else (a, (b + h) % sides[1])
    return a, b


def test_pseudonyms_match_a_network_in_python(spark):
    rng = random.Random(2)
    values = ["".join(rng.choice("09azAZ5m.") for _ in range(rng.randrange(1, 34))) for _ in range(200)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.feistel(F.col("v"), "k", "t").alias("p")).collect()
    assert all(r.p == python_feistel(r.v, "k", "t") for r in got)
    ips = [f"{rng.randrange(256)}.{rng.randrange(256)}.1.{rng.randrange(256)}" for _ in range(50)]
    for r in spark.createDataFrame([(v,) for v in ips], "v string").select("v", pii.pseudonym(F.col("v"), F.lit("ip"), "k").alias("p")).collect():
        w, x, y, z = map(int, r.v.split("."))
        a, b = python_pair(w * 256 + x, y * 256 + z, (65536, 65536), "k", "ip")
        assert r.p == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    written = ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"]
    said = [r.text for r in pii.pseudonymize(frame(spark, written), "k").orderBy("doc_id").collect()]
    digits = python_feistel("411111111111111", "k", "card")
    assert {re.sub("[ -]", "", t) for t in said} == {digits + next(c for c in "0123456789" if luhn(digits + c))} and [re.sub(r"\d", "", t) for t in said] == ["   ", "", "---"]
    phones = [r.text for r in pii.pseudonymize(frame(spark, ["+1 (212) 555-0123", "+1 212-555-0123", "212-555-0123", "mail a@x.org"]), "k").orderBy("doc_id").collect()]
    national = python_feistel("2125550123", "k", "phone")
    assert [re.sub(r"\D", "", t) for t in phones[:3]] == ["1" + national, "1" + national, national] and phones[3] != "mail a@x.org" and phones[3].endswith("@x.org")


def test_dates_and_security_numbers_stay_valid_and_apart(spark):
    days = spark.sql("select explode(sequence(date'1900-01-01', date'2099-12-31')) as d")
    forms = days.select(F.explode(F.array(*(F.date_format("d", f) for f in ("dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd")))).alias("v")).distinct().where(pii._real_date(F.col("v")))
    out = forms.select("v", pii.pseudonym(F.col("v"), F.lit("date"), "k").alias("p"))
    row = out.agg(F.count("*").alias("n"), F.count_distinct("p").alias("d"), F.count_if(~pii._real_date(F.col("p"))).alias("bad"), F.count_if(F.col("v") == F.col("p")).alias("same")).first()
    assert row.n == row.d and row.bad == 0 and row.same < 20
    rng = random.Random(4)
    numbers = sorted({f"{rng.choice([*range(1, 666), *range(667, 900)]):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}" for _ in range(5000)})
    got = spark.createDataFrame([(v,) for v in numbers], "v string").select("v", pii.pseudonym(F.col("v"), F.lit("ssn"), "k").alias("p")).collect()
    assert len({r.p for r in got}) == len(numbers) and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", r.p) for r in got)
    for r in got[:50]:
        area, group, serial = map(int, r.v.split("-"))
        a, b = python_pair((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, (898 * 99, 9999), "k", "ssn")
        assert r.p == f"{a // 99 + (2 if a // 99 >= 665 else 1):03}-{a % 99 + 1:02}-{b + 1:04}"


def test_clashing_names_stay(spark):
    docs = frame(spark, ["clean words " * 8, "clean words " * 8, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10", None, "4111 1111 1111 1111"])
    for name in ("_any", "_pieces", "_gone", "_twice", "_bad", "_hash", "cls", "rid"):
        docs = docs.withColumn(name, F.col("doc_id") * 10)
    bench = spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10")], "item_id int, text string")
    for out, left in (
        (pii.pseudonymize(docs, "k", counts=False), 5), (ngram_jaccard.without_near_duplicates(docs), 4), (decontamination.without_contaminated(docs, bench), 4), (language_id.with_known_language(docs), 3),
    ):
        rows = out.collect()
        assert out.columns == docs.columns and len(rows) == left and all(r["_any"] == r["_gone"] == r["_bad"] == 10 * r.doc_id for r in rows)


def test_long_texts_in_pieces_have_the_same_shingles(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join("w" * rng.choice([1, 3, 40, 900]) + str(rng.randrange(60)) for _ in range(n)).encode() + rng.choice([b"", b" \n"]) for n in (1, 3, 4, 5, 6, 30, 300)]
    whole = [ngram_jaccard.shingle_sets([t])[0] for t in texts]
    monkeypatch.setattr(ngram_jaccard, "LONG_TEXT", 64)
    assert all(np.array_equal(a, ngram_jaccard.shingle_sets([t])[0]) for a, t in zip(whole, texts))


def test_rows_without_ids_are_linked_by_their_texts(spark):
    words = [f"v{i}" for i in range(40)]
    near, far = " ".join([*words[:39], "other"]), " ".join(f"z{i}" for i in range(30))
    texts = [(7, " ".join(words)), (None, near), (None, near), (None, far), (None, far), (None, far + " more"), (None, None), (None, " "), (3, far.replace("z", "y"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = ngram_jaccard.ngram_jaccard_components(docs).collect()
    assert len(got) == 9 and [r.component_id for r in got if r.n_shingles and r.doc_id is None].count(7) == 2
    assert len({r.component for r in got if r.component is not None}) == 3
    kept = [(r.doc_id, r.text) for r in ngram_jaccard.without_near_duplicates(docs).collect()]
    assert len(kept) == 5 and {x for x in kept if x[0]} == {texts[0], texts[8]} and (None, None) in kept and (None, " ") in kept and (None, near) not in kept


def test_tiles_of_mixed_sides_match_brute_force(spark, monkeypatch):
    """Groups over many tiles, whose classes partly stay in different components; hot shingles go by salt."""
    monkeypatch.setattr(ngram_jaccard, "TILE", 4)
    rng = random.Random(11)
    texts, common = [], [f"common{i}" for i in range(9)]
    for family in range(12):
        base = [f"f{family}x{i}" for i in range(rng.choice([8, 25]))]
        for _ in range(9):
            w = common + base
            for _ in range(rng.randrange(3)):
                w[rng.randrange(9, len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    monkeypatch.setattr(ngram_jaccard, "_levels", lambda marked: np.ones(1 << ngram_jaccard.SKETCH_BITS, np.uint8).tobytes())
    n, comp = brute_components(texts)
    got = {r.doc_id: r for r in ngram_jaccard.ngram_jaccard_components(frame(spark, texts)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == n and [got[i].component_id for i in range(len(texts))] == comp


def test_words_of_mixed_texts_get_labels_of_their_own(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 300")
    model = language_id.fit_crf(docs)
    held = docs.where(language_id.held_out()).where("lang in ('en', 'de', 'es')").orderBy("doc_id").limit(60).collect()
    words = {lang: [w for r in held if r.lang == lang for w in language_id.words_of(r.text)] for lang in ("en", "de", "es")}
    parts = [("en", words["en"][:40]), ("de", words["de"][:30]), ("es", words["es"][:50]), ("en", words["en"][40:60])]
    mixed = spark.createDataFrame([(1, "12 " + ", ".join(w for _, ws in parts for w in ws), "en"), (2, None, "en"), (3, " 7", "en")], "doc_id long, text string, lang string")
    got = language_id.word_labels(mixed, model).orderBy("at").collect()
    want = [lang for lang, ws in parts for _ in ws]
    assert [(r.doc_id, r.at, r.word) for r in got] == [(1, i, w) for i, w in enumerate(w for _, ws in parts for w in ws)]
    assert np.mean([r.label == y for r, y in zip(got, want)]) > 0.9 and all(0.25 <= r.posterior <= 1.0001 for r in got)


def test_word_features_depend_on_the_word_alone():
    words = ["a", "ab", "Abc", "straße", "İstanbul", "x" * 70, "é"]
    together = language_id.Features(words, {"ab": 1}, 3)
    rng = np.random.default_rng(0)
    weights = rng.normal(size=((1 << language_id.BITS) + 4, 3)).astype(np.float32)
    alone = [language_id.Features([w], {"ab": 1}, 3).score(weights)[0] for w in words]
    assert np.allclose(together.score(weights), alone, atol=1e-4)
    grad, per_word = np.zeros(weights.shape), rng.normal(size=(len(words), 3))
    together.add_to(grad, per_word)
    assert np.isclose((grad * weights).sum(), (per_word * together.score(weights)).sum(), rtol=1e-4)


def test_proximity_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(14)]
    texts = [None, "", *(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(25))]
    texts[5] = texts[4]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (2, 3, 4, 12)] + ["t1 t1 t2", "absent t1"]
    docs, bench = frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    words = [(t or "").split() for t in texts]
    df = {w: sum(ws.count(w) for ws in words) for w in [*vocabulary, "absent"]}
    wins = {tuple(i.split()[k : k + 10]) for i in items for k in range(max(1, len(i.split()) - 9))}
    for near in (1, 3, 8):
        want = []
        for ws in words:
            n = 0
            for win in wins:
                few = {w for _, w, _ in sorted((df[w], w, k) for k, w in enumerate(win))[:3]}
                if min(df[w] for w in win) and any(few <= set(ws[max(0, p - near + 1) : p + 1]) for p in range(len(ws))):
                    n += 1
            want.append(n)
        plain = decontamination.decontaminate(docs, bench).orderBy("doc_id").collect()
        got = decontamination.decontaminate(docs, bench, near=near).orderBy("doc_id").collect()
        assert [r.n_near for r in got] == want
        assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got] == [(r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in plain]
    keyed = decontamination.keyed(docs).dropDuplicates(["dk", "th"])
    terms = decontamination.phrase_windows(bench)[2]
    index = decontamination.postings(keyed, terms)
    asked = terms.where("term in ('t1', 't2', 't3')").select(F.lit(1).alias("qid"), "tid")
    name = {r.tid: r.term for r in terms.collect()}
    got = decontamination.proximity_matches(index, asked, 2).join(keyed.select("dk", "th", "doc_id"), ["dk", "th"]).collect()
    first = min((df[w], t) for t, w in name.items() if w in ("t1", "t2", "t3"))[1]
    want = set()
    for i, ws in enumerate(words):
        for p, w in enumerate(ws):
            if w == name[first] and all(x in ws[max(0, p - 2) : p + 3] for x in ("t1", "t2", "t3")):
                want.add((i, p + 1))
    assert {(r.doc_id, r.pos) for r in got} == want


def test_many_windows_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    docs = frame(spark, ["x q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 y", "q1 q2", None])
    bench = spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10")], "item_id int, text string")
    assert [(r.n_hit, r.n_near) for r in decontamination.decontaminate(docs, bench, near=20).orderBy("doc_id").collect()] == [(10, 1), (0, 0), (0, 0)]


def python_battery(token):
    """The four statistics and the grid cell, in plain Python."""
    plain = token.rstrip("=")
    k = 10 if re.fullmatch("[0-9]+", plain) else 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", plain) else 32 if re.fullmatch("[A-Z2-7]+", plain) else 64
    letters = secrets.ALPHABETS[k]
    code = [letters.index(c.lower() if k == 16 else {"-": "+", "_": "/"}.get(c, c)) for c in plain]
    n = len(code)
    square = sum(code.count(c) ** 2 for c in set(code))
    z1 = (k / n * square - n - (k - 1)) / (2 * (k - 1)) ** 0.5
    cuts = [0, *{10: (5,), 16: (10,), 32: (26,), 64: (26, 52, 62)}[k], k]
    chi = sum((sum(a <= c < b for c in code) - n * (b - a) / k) ** 2 / (n * (b - a) / k) for a, b in zip(cuts, cuts[1:]))
    z2 = (chi - (len(cuts) - 2)) / (2 * (len(cuts) - 2)) ** 0.5
    runs = 1 + sum((a < k / 2) != (b < k / 2) for a, b in zip(code, code[1:]))
    z3 = (runs - 1 - (n - 1) / 2) / ((n - 1) / 4) ** 0.5
    middle = (k - 1) / 2
    z4 = sum((a - middle) * (b - middle) for a, b in zip(code, code[1:])) / ((k * k - 1) / 12 * (n - 1) ** 0.5)
    worst = max(z1, 0.8 * z2, abs(z3), abs(z4))
    log_p = max(0.0, (worst * worst / 2 + np.log(1 + worst)) / np.log(10) - np.log10(4))
    return (z1, z2, z3, z4), min(secrets.TOP, int(log_p * secrets.GRID)), 0 if n < 28 else 1 if n < 40 else 2 if n < 64 else 3


def test_randomness_battery_and_discovery_control_match_python(spark):
    rng = random.Random(6)
    alphabets = ["0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcXYZ019+/-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    drawn = ["".join(rng.choice(rng.choice(alphabets[-1:])) for _ in range(rng.randrange(20, 90))) + rng.choice(["", "="]) for _ in range(60)]
    tokens = drawn + ["".join(rng.choice(a) for _ in range(rng.randrange(20, 70))) for a in alphabets[:5] for _ in range(12)] + ["a" * 30, "ab" * 20, "abcdefghijklmnopqrstuvwxyz", "thisisaveryordinarysentencewithoutblanks"]
    rows = secrets._battery(spark.createDataFrame([(t,) for t in tokens], "part string")).collect()
    for r in rows:
        z, cell, band = python_battery(r.part)
        assert np.allclose([r.z1, r.z2, r.z3, r.z4], z, atol=1e-9) and abs(r.cell - cell) <= (0 if cell == secrets.TOP else 1) and r.band == band, r.part
    tested = spark.createDataFrame([(r.band, r.cell) for r in rows], "band int, cell int")
    got = {r.band: r.rejected for r in secrets.rejected_from(tested, 0.05).collect()}
    for band in range(4):
        cells = sorted((r.cell for r in rows if r.band == band), reverse=True)
        # the largest p-value p(i) with p(i) <= q i / m, equal ones counted together
        ok = [c for c in set(cells) if 10 ** (-c / secrets.GRID) <= 0.05 * sum(x >= c for x in cells) / len(cells)]
        assert got.get(band) == (min(ok) if ok else None)
    texts = [" ".join(f"say {t} now" for t in tokens)]
    spans = secrets.scan_secrets(frame(spark, texts)).first()
    said = [x.split(":") for x in spans.spans.split(",") if x.startswith("random")]
    kept = {texts[0][int(a) : int(b)] for _, a, b in said}
    want = {r.part for r in rows if got.get(r.band) is None or r.cell < got[r.band]}
    assert spans.n_random == len(said) and kept == want and sum(t in kept for t in drawn) > 50 and "a" * 30 not in kept


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_matches_edit_distance():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
    terms = sorted({word() for _ in range(40)} - {""})
    automaton = toxicity.TrieAutomaton(terms)
    for _ in range(3000):
        w = word()
        near = [(edits(w, t), k) for k, t in enumerate(terms)]
        near = [(e, k) for e, k in near if e == 0 or (e == 1 and len(terms[k]) >= toxicity.TrieAutomaton.FUZZY_FROM)]
        assert automaton.match(w) == min(near, default=None), w


def test_toxicity_without_marks_is_the_prior(spark):
    texts = ["a plain text", None, ""]
    for rows in ([], [(0, 0), (1, 0)], [(0, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        got = toxicity.score_toxicity(frame(spark, texts), labels).collect()
        assert [r.predicted for r in got] == [0, 0, 0] and all(abs(r.score - 0.018) < 0.001 for r in got)


def test_context_limits_match_brute_force(spark):
    rng = random.Random(2)
    sizes = [0, 0, 5, *(rng.randrange(4000) for _ in range(80))]
    hist = spark.createDataFrame([(s, sizes.count(s)) for s in set(sizes)], "length long, n_docs long")
    for span in (7, 1024):
        limits = token_counts.context_limits(hist, span).persist()
        wanted = [0, 1, 5, 6, 2048, max(sizes), 10**6]
        rows = limits.collect() + token_counts.at_limits(limits, wanted).collect()
        assert sorted(r.context_limit for r in rows) == sorted([*set(sizes), *wanted])
        for r in rows:
            c = r.context_limit
            assert r.docs_at_least == sum(s >= c for s in sizes) and r.tokens_at_least == sum(s for s in sizes if s >= c) and r.n_docs == sizes.count(c)
            fit = sum(s <= c for s in sizes)
            assert r.docs_that_fit == fit and r["quantile"] == fit / len(sizes) and r.truncated_total == sum(min(s, c) for s in sizes) and r.total == sum(sizes)
        for share in (0.01, 0.5, 0.9, 1.0):
            assert token_counts.quantile(limits, share) == min(c for c in sizes if sum(s <= c for s in sizes) >= share * len(sizes))
    empty = token_counts.context_limits(hist.limit(0))
    assert token_counts.at_limits(empty, [5]).count() == 0 and token_counts.quantile(empty, 0.5) is None


def test_staged_tables_can_be_dropped(spark):
    from pathlib import Path

    out = quality.quality_rules(frame(spark, ["some words here"]))
    assert out.count() == 1
    from quillspark.llm import common

    paths = [Path(p.removeprefix("file://")) for p in common._written]
    assert paths and all(p.exists() for p in paths) and common.drop_staged(spark) == len(paths) and not any(p.exists() for p in paths)


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    import os
    import time

    from quillspark.llm import common

    def shuffled():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(common.CLEANUP_KEY, None)
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    out = common.staged(rows.join(rows.groupBy("k").count(), "k").repartition(3, "id"), "shuffled")
    ends = time.time() + 10
    while shuffled() - before and time.time() < ends:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(common.CLEANUP_KEY, None) == setting
    assert out.count() == 1000 and out.agg(F.sum("count")).first()[0] == 6 * 143 * 143 + 142 * 142


def test_tables_on_the_way_to_components_go(spark):
    from pathlib import Path

    from quillspark.llm import common

    common.drop_staged(spark)
    text = [f"w{i}" for i in range(40)]
    texts = [" ".join(text), " ".join(text[:-1] + ["z"]), " ".join(text), "other words than these", "", None]
    for some in (texts, texts[3:]):
        out = ngram_jaccard.ngram_jaccard_components(frame(spark, some))
        left = {Path(p).name.split("-")[0] for p in common._written}
        assert left <= {"rows", "classes", "all_links", "edges", "step", "labels"} and {"rows", "classes"} <= left
        assert not set(out.columns) & {"bits", "hashes"}
        found = {r["doc_id"]: r["component_id"] for r in out.collect()}
        assert len(found) == len(some) and (some is not texts or sorted(found.values())[:3] == [min(found)] * 3)
        assert all(Path(p.removeprefix("file://")).exists() for p in common._written)
