"""Sources: JSON lines, images, archives' byte ranges, URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import StructType

#: Suffixes of archives, and the form of part numbers.
ARCHIVES = ("tar.gz", "tgz", "tar.bz2", "tar.xz", "tar", "zip", "gz", "bz2", "xz", "7z", "rar")
PART = r"\.(?:part)?(\d+)$"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One record a line, blank lines skipped. strict: a bad record is an error that names its file, line number and text; else it is a row of nulls."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path")).where(F.trim("value") != "")
    marker = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*marker.fields]).add("_bad", "string")
    rows = lines.select("_path", "value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    if strict:
        first = rows.where(bad).select("_path", "value").limit(1).collect()
        if first:
            raise ValueError(f"bad record in {first[0]._path}:{_line_of(spark, first[0]._path, first[0].value)}: {first[0].value[:200]}")
    return rows.select(*(F.col("r")[f.name].alias(f.name) for f in marker))


def _line_of(spark: SparkSession, path: str, text: str) -> int | None:
    """Number of the first line of a file that reads so. Only a file with a bad record is numbered, in the order of its parts."""
    numbered = spark.read.text(path).rdd.map(lambda r: r.value).zipWithIndex()
    return numbered.filter(lambda x: x[0] == text).map(lambda x: x[1] + 1).min()


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, channels, mode, data of images as the JVM decodes them; files that are no image are left out. `operators.images.read` turns
    them upright and says what happens to such files."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.mode", "image.data")


def byte_range(content: Column, offset: Column, length: Column) -> Column:
    """A member of an archive by offset and length; both are required, and the member lies within the archive."""
    missing = offset.isNull() | length.isNull()
    outside = (offset < 0) | (length < 0) | (offset + length > F.octet_length(content))
    fault = lambda text: F.raise_error(F.lit(text)).cast("binary")
    member = F.substring(content, (offset + 1).cast("int"), length.cast("int"))
    return F.when(missing, fault("offset and length are required")).when(outside, fault("the member lies outside the archive")).otherwise(member)


def range_of(uri: Column) -> tuple[Column, Column]:
    """Offset and length that a URI's query names (`?offset=&length=`); null where it does not."""
    part = lambda name: F.try_to_number(F.nullif(F.regexp_extract(uri, rf"[?&]{name}=(\d+)(?:&|#|$)", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    return part("offset"), part("length")


def tar_members(files: DataFrame, members: DataFrame) -> DataFrame:
    """members (uri `<path>?offset=&length=`) -> uri, content, from files (path, content). Paths that no file has, and ranges that are not named or lie
    outside, are errors."""
    offset, length = range_of(F.col("uri"))
    asked = members.select("uri", F.regexp_replace("uri", r"[?#].*$", "").alias("path"), offset.alias("offset"), length.alias("length"))
    found = asked.join(files.select("path", "content"), "path", "left")
    whole = F.coalesce(F.col("content"), F.raise_error(F.concat(F.lit("no file "), "path")).cast("binary"))
    return found.select("uri", byte_range(whole, F.col("offset"), F.col("length")).alias("content"))


def load_bytes(spark: SparkSession, uris: DataFrame, column: str = "uri", timeout: int = 10) -> DataFrame:
    """uri, content: what each URI holds. Paths that Spark's file systems read are read by tasks through pyarrow, http(s) by a request; others are an
    error that names the scheme. Ranges that a URI names are read alone."""

    def run(batches):
        import urllib.parse
        import urllib.request

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                parts = urllib.parse.urlsplit(uri)
                asked = dict(urllib.parse.parse_qsl(parts.query))
                lo, n = (int(asked["offset"]), int(asked["length"])) if {"offset", "length"} <= set(asked) else (0, None)
                if parts.scheme in ("http", "https"):
                    headers = {} if n is None else {"Range": f"bytes={lo}-{lo + n - 1}"}
                    with urllib.request.urlopen(urllib.request.Request(uri, headers=headers), timeout=timeout) as r:
                        out.append(r.read())
                elif parts.scheme in ("", "file", "hdfs", "s3", "gs"):
                    store, path = fs.FileSystem.from_uri(urllib.parse.urlunsplit(parts._replace(query="", fragment="")) if parts.scheme else f"file://{parts.path}")
                    with store.open_input_file(path) as f:
                        out.append(f.read() if n is None else f.read_at(n, lo))
                else:
                    raise ValueError(f"no way to read {parts.scheme}://")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["uri", "content"])

    return uris.select(F.col(column).alias("uri")).mapInArrow(run, "uri string, content binary")


def url_paths(url: Column) -> dict[str, Column]:
    """Names that a download of the URL gets: hash, file name, extension, part number, whether it is a part or an archive."""
    name = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    suffix = "|".join(s.replace(".", r"\.") for s in ARCHIVES)
    return {
        "url_hash": F.sha2(url.cast("binary"), 256),
        "file_name": name,
        "ext": F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1),
        "scheme": F.regexp_extract(url, r"^([a-z]+)://", 1),
        "is_part": name.rlike(PART),
        "is_archive": name.rlike(rf"\.({suffix})$"),
        "part": F.nullif(F.regexp_extract(name, PART, 1), F.lit("")).cast("int"),
        "stem": F.regexp_replace(F.regexp_replace(name, PART, ""), rf"\.({suffix})$", ""),
    }


def split(df: DataFrame, name: str, max_samples: int | None = None, pos: str = "_pos") -> DataFrame:
    """Rows of one split, at most max_samples of them in view order; unknown splits and negative caps are errors."""
    from ..schemas import SPLITS

    if name not in SPLITS:
        raise ValueError(f"no split {name!r}; known: {', '.join(SPLITS)}")
    if max_samples is not None and max_samples < 0:
        raise ValueError("a cap is not negative")
    rows = df.where(F.col("split") == name)
    return rows if max_samples is None else rows.orderBy(pos).limit(max_samples)


def with_token(url: str, token: str | None) -> str:
    return url.replace("{access_token}", token or "")
