"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Each response gives two records that refer to it (``WARC-Refers-To``) and keep its URI, date, HTTP
headers and payload digest. Identifiers are digests of the response, so a task that runs again makes
the same records. ``write_warc`` writes them as WARC 1.1 files through Spark's text writer.

Defined cases: a null page is an empty payload and gives an empty conversion; a null URL is an empty
URI and has no outlinks; repeated rows give the same identifiers; links and entities that are
malformed are left as they stand.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices

#: The date of records whose table has none.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(
    r"</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|td|th|article|section|nav|footer|header|body|html|head|blockquote|pre|form|hr|main|aside|figure)\b"
    r"""(?:[^>"']|"[^"]*"|'[^']*')*>""",
    re.I,
)
_TAG = re.compile(r"""<[a-zA-Z/!?](?:[^<>"']|"[^"]*"|'[^']*')*>|<[a-zA-Z/!?][^<>]*>""")
_HREF = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_GAPS = re.compile(r"[ \t\r\f\v\xa0]+")


def plain_text(page: str) -> str:
    """The visible text: a line for each block, entities resolved, runs of blanks as one."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (_GAPS.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(page: str) -> str:
    found = _TITLE.search(page)
    return " ".join(html.unescape(_TAG.sub("", found[1])).split()) if found else ""


def outlinks(page: str, url: str) -> list[str]:
    """Targets of a page's links in their order, each once, as absolute addresses."""
    out: dict[str, None] = {}
    for m in _HREF.finditer(_HIDDEN.sub(" ", page)) if url else ():
        target = html.unescape(next(g for g in m.groups() if g is not None)).strip()
        try:
            out[" ".join(urljoin(url, target).split())] = None
        except ValueError:
            out[" ".join(target.split())] = None
    return list(out)


def urn(*parts: Column) -> Column:
    """A record identifier made of a digest of the parts."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages: ``page_id, record_id, target_uri, warc_date, status, headers, payload, payload_digest``."""
    date = F.col("warc_date").cast("string") if "warc_date" in pages.columns else F.lit(None).cast("string")
    read = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("target_uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
        F.coalesce(date, F.lit(DATE)).alias("warc_date"),
    )
    headers = F.array(F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.octet_length("payload")))
    return read.select(
        "page_id",
        urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.col("payload")).alias("record_id"),
        "target_uri",
        "warc_date",
        F.lit(200).alias("status"),
        headers.alias("headers"),
        "payload",
        digest(F.col("payload")).alias("payload_digest"),
    )


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record."""
    kept = ["page_id", "record_id", "target_uri", "warc_date", "status", "headers", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 100):
                pages, urls = part.column("payload").to_pylist(), part.column("target_uri").to_pylist()
                columns = [*(part.column(c) for c in kept), pa.array([title_of(p) for p in pages], pa.string()), pa.array([outlinks(p, u) for p, u in zip(pages, urls)], pa.list_(pa.string())), pa.array([plain_text(p) for p in pages], pa.string())]
                yield pa.record_batch(columns, [*kept, "title", "outlinks", "plain"])

    read = records.select(*kept, "payload")
    schema = ", ".join(f"{c} {k}" for c, k in read.drop("payload").dtypes)
    parsed = read.mapInArrow(run, f"{schema}, title string, outlinks array<string>, plain string")
    fields = F.concat(
        F.array(
            F.concat(F.lit("title: "), F.col("title")),
            F.concat(F.lit("http-status: "), F.col("status")),
            F.concat(F.lit("payload-digest: "), F.col("payload_digest")),
        ),
        F.transform("headers", lambda h: F.concat(F.lit("source-header: "), h)),
        F.transform("outlinks", lambda u: F.concat(F.lit("outlink: "), u)),
    )
    lines = F.concat(F.array_join(fields, CRLF), F.lit(CRLF))
    made = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content"), lines.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content"), F.col("plain").alias("block")),
    )
    each = parsed.select(*kept, F.explode(made).alias("r"))
    return each.select(
        "page_id",
        F.col("r.type").alias("record_type"),
        urn(F.col("r.type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("r.content").alias("content_type"),
        "status",
        F.array_join("headers", CRLF).alias("source_headers"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.col("r.block").alias("block"),
        F.octet_length("r.block").cast("long").alias("content_length"),
        digest(F.col("r.block")).alias("block_digest"),
    )


def serialised(derived: DataFrame) -> DataFrame:
    """``value``: each record's header and block; records end with two line breaks, which the writer adds."""
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
        F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("target_uri", r"\s+", "%20")),
        F.concat(F.lit("WARC-Date: "), F.col("warc_date")),
        F.concat(F.lit("WARC-Block-Digest: "), F.col("block_digest")),
        F.concat(F.lit("Content-Type: "), F.col("content_type")),
        F.concat(F.lit("Content-Length: "), F.col("content_length")),
    ]
    return derived.select(F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF + CRLF), F.col("block")).alias("value"))


def write_warc(derived: DataFrame, path: str, compression: str = "none") -> None:
    serialised(derived).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)
