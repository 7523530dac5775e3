"""Content-addressed web archive.

A record's payload is stored once, under its SHA-256 and length; the exact header bytes of every record are stored beside it, with the
digest that leads to the payload. Reading joins both back to the original records, checks each payload against its
digest, and parses the records. All steps are column expressions.

Two tables: ``payloads`` (digest, n_bytes, payload) and ``headers`` (id, head, digest, type). A record of type ``response`` has the
payload; a later or smaller one with an equal payload is a ``revisit`` that refers to it.

Defined results: a null payload counts as empty, a null URL as empty; line ends in a URL are percent-encoded, as a header is one line. Of
equal payloads, the rows with the largest id are responses (several, if a row is repeated; the payload is stored once all the same);
rows with a null id are revisits unless no equal payload has an id. Empty tables give empty archives. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import keyed, materialize, shared_dir

CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as 32 upper-case base-32 digits: 8 groups of 20 bits, each 5 hexadecimal or 4 base-32 digits."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.sha1(payload).substr(i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    digit = lambda g, shift: F.lit(ALPHABET).substr(F.shiftright(g, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda g: F.concat(*(digit(g, s) for s in (15, 10, 5, 0)))), "")


def record_uri(record_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", record_id.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(h.substr(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def facts_of(rows: DataFrame, min_bytes: int) -> DataFrame:
    """``id, url, digest, sha1, n_bytes, owner, owner_rows`` of ``id, url, payload``: who keeps the payload. Payloads themselves are not shuffled."""
    facts = materialize(rows.select("id", "url", F.sha2("payload", 256).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("bigint").alias("n_bytes")), "facts")
    owners = facts.groupBy("digest", "id").count().groupBy("digest").agg(F.max("id").alias("owner"), F.coalesce(F.max_by("count", "id"), F.sum("count")).alias("owner_rows"))
    facts = facts.join(owners, "digest")
    own = (F.col("n_bytes") < min_bytes) | F.col("id").eqNullSafe(F.col("owner"))
    return facts.withColumn("type", F.when(own, "response").otherwise("revisit"))


def header(date: str) -> Column:
    """Header block of a record up to the blank line, and the HTTP head that starts its block."""
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("type") == "revisit"
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    lines = [
        F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("type")),
        F.concat(F.lit("WARC-Record-ID: "), record_uri(F.col("id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_uri(F.col("owner"), F.col("digest")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http).cast("binary")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Store every row of ``pages`` as a record under ``path``."""
    rows = keyed(pages, id_col, url_col, "url", payload_col, "payload").select("id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    facts = facts_of(rows, min_bytes)
    facts.select("id", header(date).alias("head"), "digest", "type").write.option("compression", "zstd").parquet(f"{path}/headers")
    # Rows that do not keep their payload are few where pages differ: then Spark broadcasts them, and payloads go from the source to the store unshuffled.
    others = materialize(facts.where(~F.col("id").eqNullSafe(F.col("owner"))).select("id", "digest").distinct(), "others")
    mine = rows.withColumn("digest", F.sha2("payload", 256)).join(others.withColumnsRenamed({"id": "i", "digest": "d"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left_anti")
    mine = mine.select("digest", F.octet_length("payload").cast("bigint").alias("n_bytes"), "payload")
    if facts.where("owner_rows > 1").limit(1).count():
        mine = mine.dropDuplicates(["digest"])  # a row that keeps its payload is there twice
    mine.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``id, digest, type, record`` of every record, its bytes as they were; a payload that does not fit its digest fails the query."""
    payloads, headers = spark.read.parquet(f"{path}/payloads"), spark.read.parquet(f"{path}/headers")
    whole = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("n_bytes"))
    payloads = payloads.select("digest", F.when(whole, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")).alias("payload"))
    end = F.lit(CRLF * 2).cast("binary")
    full = headers.where("type = 'response'").join(payloads, "digest").select("id", "digest", "type", F.concat("head", "payload", end).alias("record"))
    return full.unionByName(headers.where("type <> 'response'").select("id", "digest", "type", F.concat("head", end).alias("record")))


def parse(records: DataFrame) -> DataFrame:
    """Adds what the bytes of ``record`` say: ``warc_type, record_uri, target_uri, stated_digest, refers_uri, payload``."""
    text = F.col("record").cast("string")
    head = F.substring_index(text, CRLF * 2, 1)
    rows = records.withColumn("head", head)
    field = lambda name: F.nullif(F.regexp_extract("head", f"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
    rows = rows.withColumn("block", F.substr("record", F.octet_length("head") + F.lit(5), field("Content-Length").cast("int")))
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), CRLF * 2, 1)) + F.lit(5)
    return rows.select(
        *records.columns, field("WARC-Type").alias("warc_type"), field("WARC-Record-ID").alias("record_uri"), field("WARC-Target-URI").alias("target_uri"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"), field("WARC-Refers-To").alias("refers_uri"),
        F.when(field("WARC-Type") == "response", F.substr("block", http)).alias("payload"))


def round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write, read back, parse: ``id, payload_bytes, payload_digest, record_type, refers_to`` of every record, all from the archive's bytes."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "archive")
    write_archive(pages, path, id_col, url_col, payload_col, min_bytes)
    read = parse(read_archive(spark, path)).select("id", "digest", "warc_type", F.octet_length("payload").cast("bigint").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))
    read = materialize(read, "records")
    responses = read.where("warc_type = 'response'")
    kept = responses.groupBy("digest").agg(F.max("id").alias("kept"), F.max("n").alias("n_kept"), F.max("sha1").alias("sha1_kept"))
    revisits = read.where("warc_type <> 'response'").join(kept, "digest", "left")
    return responses.select("id", F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast(read.schema["id"].dataType).alias("refers_to")).unionByName(
        revisits.select("id", F.col("n_kept").alias("payload_bytes"), F.col("sha1_kept").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.col("kept").alias("refers_to")))
