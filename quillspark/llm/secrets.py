"""Secret scans with a randomness battery (operator 8). DataFrame operations only.

Base kinds are patterns (assign, access, hex). The method adds spans of kind `random`: long tokens whose encoding is inferred (digits, hex, base 32,
base 64) and which four tests do not tell from uniform draws over it: chi-squared over the alphabet, chi-squared over its character classes, runs
about its middle, and serial correlation. The tests make one p-value under randomness; Benjamini-Hochberg, run within each band of lengths over all
tokens of the corpus on a fixed grid of p-values, rejects randomness; what is not rejected is reported. Counts per band and grid cell are all that is
gathered, a table of fixed size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.column import Column

from .common import staged

#: The patterns of the base kinds. Runs of access keys and hexadecimal digits are greedy, so asking for their least length finds the same
#: matches as dropping shorter ones afterwards: what is left of a run behind its beginning is shorter still.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
FDR, GRID, TOP = 0.05, 20, 400
ALPHABETS = {10: "0123456789", 16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def _found(text: Column, pattern: str, group: int, kind: int) -> Column:
    """Array of (kind, gap: length of the text since the match before, size: of the match, part: its group), in order."""
    taken = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), taken(0).alias("hit"), taken(group).alias("part"))
    one = lambda r: F.struct(F.lit(kind).alias("kind"), F.length(r["gap"]).alias("gap"), F.length(r["hit"]).alias("size"), r["part"].alias("part"))
    return F.when(text.rlike(pattern), F.filter(F.transform(rows, one), lambda r: r.size.isNotNull()))


def _battery(df: DataFrame) -> DataFrame:
    """Adds cell (of the grid of -log10 p) and band to rows with `part`."""
    plain = F.rtrim(F.col("part"), F.lit("="))
    size = F.when(plain.rlike("^[0-9]+$"), 10).when(plain.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(plain.rlike("^[A-Z2-7]+$"), 32).otherwise(64)
    df = df.withColumns({"k": size, "chars": F.split(plain, "")})
    alphabet = F.when(F.col("k") == 10, ALPHABETS[10]).when(F.col("k") == 16, ALPHABETS[16]).when(F.col("k") == 32, ALPHABETS[32]).otherwise(ALPHABETS[64])
    df = df.withColumn("alphabet", alphabet)
    place = lambda c: F.instr(F.col("alphabet"), F.when(F.col("k") == 16, F.lower(c)).when(c == "-", "+").when(c == "_", "/").otherwise(c)) - 1
    # explode of one element keeps the codes from being computed once per use
    df = df.withColumn("code", F.explode(F.array(F.transform("chars", place)))).withColumn("n", F.size("code").cast("double"))
    k, n = F.col("k").cast("double"), F.col("n")
    square = F.aggregate(F.array_distinct("code"), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter("code", lambda x: x == c)).cast("double"), F.lit(2.0)))
    z_alphabet = (k / n * square - n - (k - 1)) / F.sqrt(2 * (k - 1))
    share = lambda lo, hi: F.size(F.filter("code", lambda x: (x >= lo) & (x < hi))).cast("double")
    edges = {10: (5,), 16: (10,), 32: (26,), 64: (26, 52, 62)}

    def z_class(size: int) -> Column:
        cuts = [0, *edges[size], size]
        chi = sum(F.pow(share(a, b) - n * ((b - a) / size), F.lit(2.0)) / (n * ((b - a) / size)) for a, b in zip(cuts, cuts[1:]))
        d = len(cuts) - 2
        return (chi - d) / (2 * d) ** 0.5

    z_classes = F.when(F.col("k") == 10, z_class(10)).when(F.col("k") == 16, z_class(16)).when(F.col("k") == 32, z_class(32)).otherwise(z_class(64))
    pairs = F.arrays_zip(F.slice("code", F.lit(1), F.size("code") - 1).alias("a"), F.slice("code", F.lit(2), F.size("code") - 1).alias("b"))
    runs = 1.0 + F.size(F.filter(pairs, lambda p: (p["a"] < k / 2) != (p["b"] < k / 2))).cast("double")
    z_runs = (runs - 1 - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    middle, spread = (k - 1) / 2, (k * k - 1) / 12
    serial = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - middle) * (p["b"] - middle))
    z_serial = serial / (spread * F.sqrt(n - 1))
    df = df.withColumns({"z1": z_alphabet, "z2": z_classes, "z3": z_runs, "z4": z_serial})
    # the largest of the four, two-sided where low values are odd too, with a Bonferroni factor of four
    worst = F.greatest(F.col("z1"), F.col("z2") * 0.8, F.abs("z3"), F.abs("z4"))
    log_p = F.greatest(F.lit(0.0), (F.col("worst") * F.col("worst") / 2 + F.log(1 + F.col("worst"))) / F.log(F.lit(10.0)) - F.log10(F.lit(4.0)))
    df = df.withColumn("worst", F.greatest(F.lit(0.0), worst)).withColumn("cell", F.least(F.lit(TOP), F.floor(log_p * GRID)).cast("int"))
    band = F.when(n < 28, 0).when(n < 40, 1).when(n < 64, 2).otherwise(3)
    return df.withColumn("band", band)


def rejected_from(tested: DataFrame, fdr: float) -> DataFrame:
    """band, rejected: the least cell whose tokens Benjamini-Hochberg tells from random draws, for the bands that have one. Tokens are counted by band
    and cell, so at most four times TOP + 1 rows are ordered."""
    cells = tested.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("band").orderBy(F.desc("cell"))
    cells = cells.withColumns({"rank": F.sum("c").over(upto), "m": F.sum("c").over(Window.partitionBy("band"))})
    return cells.where(F.pow(F.lit(10.0), -F.col("cell") / GRID) <= fdr * F.col("rank") / F.col("m")).groupBy("band").agg(F.min("cell").alias("rejected"))


def scan_secrets(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_assign, n_access, n_hex, base_sha256, n_random, spans; one row for each row.

    Null and empty texts have no spans: counts 0, the hash of an empty string, spans ''. Repeated rows each count for the error control. An empty
    table gives an empty result; other columns are ignored. Offsets are code points, ends exclusive.
    """
    text = F.col("text")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = "array<struct<kind:int,gap:int,size:int,part:string>>"
    found = [_found(text, ASSIGN, 2, 0), _found(text, ACCESS, 0, 1), _found(text, HEX, 0, 2), _found(text, TOKEN, 0, 3)]
    # one entry without a kind stands for the document itself, so documents without spans stay and rows are numbered in a single pass
    own = F.array(F.struct(F.lit(None).alias("kind"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(None).alias("part"))).cast(kinds)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(own, *(F.coalesce(f, F.array().cast(kinds)) for f in found)).alias("found"))
    rows = rows.select("row", "doc_id", F.posexplode("found").alias("at", "m")).select("row", "doc_id", "at", "m.*")
    stop = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("at"))
    least = F.when(F.col("kind") == 0, 6).when(F.col("kind") == 2, 24).otherwise(20)
    spans = rows.withColumn("stop", stop).where(F.col("kind").isNull() | (F.length("part") >= least)).select("row", "doc_id", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop", "part")
    spans = staged(spans, "spans")
    tested = _battery(spans.where("kind = 3")).select("row", "start", "stop", "band", "cell")
    limit = rejected_from(tested, fdr)
    kept = tested.join(F.broadcast(limit), "band", "left").where(F.col("rejected").isNull() | (F.col("cell") < F.col("rejected"))).select("row", F.lit(3).alias("kind"), "start", "stop")
    names = F.array(*map(F.lit, KINDS))
    base = spans.where("kind is null or kind < 3").select("row", "doc_id", "kind", "start", "stop")
    all_spans = base.unionByName(kept.select("row", F.lit(None).cast("long").alias("doc_id"), "kind", "start", "stop"))
    one = F.struct("start", "kind", F.concat_ws(":", F.get(names, F.col("kind")), "start", "stop").alias("said"))
    per = all_spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        *(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("s"),
    )
    said = lambda keep: F.array_join(F.transform(F.filter("s", lambda x: keep(x)), lambda x: x.said), ",")
    return per.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(said(lambda x: x.kind < 3).cast("binary"), 256).alias("base_sha256"), "n_random", said(lambda x: x.kind >= 0).alias("spans"))
