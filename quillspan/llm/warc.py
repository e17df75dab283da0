"""Resolution of not-modified revisit records in web archives.

An as-of join: every revisit meets the latest earlier full response of its
canonical URL, in one window over the captures of that URL, so payloads are
shuffled once. Validators must agree, then the 304's permitted headers replace
those of the stored response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_clashes, fresh, named

PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "(utm_[a-z]+|ref|fbclid|gclid)"
_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]*)([^?#\s]*)(?:\?([^#\s]*))?"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, no tracking parameters, the others sorted, ``/`` for an empty path.

    What isn't ``scheme://...`` only loses its fragment; null stays null.
    """
    scheme, host, path, query = (F.regexp_extract(url, _URL, i) for i in range(1, 5))
    scheme, host = F.lower(scheme), F.lower(host)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)"))), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(scheme != "", whole).otherwise(F.trim(F.regexp_replace(url, "#.*$", "")))


def _lower_names(headers: Column) -> Column:
    """The map with names in lower case; of names that differ in case only, the last entry holds."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def merge_headers(stored: Column, update: Column) -> Column:
    """Headers of the stored response with those that a 304 may update (``PERMITTED``). Names are in lower case already."""
    new = F.map_filter(F.coalesce(update, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    old = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(old, new)


def _strong(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every record, revisits completed by the response that they refer to.

    ``records``: record_id, uri, date, kind (``response`` or ``revisit``), status,
    headers map<string,string>, payload, and any other columns, which are kept.
    Added: canonical_uri, refers_to (record_id of the response) and outcome:

    * ``full``: not a revisit; unchanged but for lower-case header names;
    * ``resolved``: status and payload are those of the latest earlier record of
      the canonical URL that is a response of status 200 with a payload, headers
      are merged;
    * ``mismatch``: that response has other validators. Entity tags count
      (weakly compared) where both records have one, else Last-Modified;
    * ``no validator``: the records have no validator in common;
    * ``no response``: there is no earlier one, or URL or date are null.

    Earlier: a smaller date, on the same date responses before revisits, then
    the smaller record_id (nulls first). Unresolved revisits keep what they have.
    Repeated rows are resolved each for itself. Input columns named like the
    added ones are replaced. An empty table gives an empty table. Payloads of any
    length are copied whole.
    """
    records = drop_clashes(records, "canonical_uri", "refers_to", "outcome")
    base, head = fresh(records, "base"), fresh(records, "head")
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("payload").isNotNull() & F.col("date").isNotNull()
    keyed = records.withColumns({"canonical_uri": canonical_url(F.col("uri")), "headers": _lower_names(F.col("headers"))})
    earlier = Window.partitionBy("canonical_uri").orderBy(F.col("date").asc_nulls_first(), F.col("kind") == "revisit", F.col("record_id").asc_nulls_first(), F.xxhash64(F.col("payload"), F.col("status"))).rowsBetween(Window.unboundedPreceding, -1)
    found = keyed.withColumn(base, F.last(F.when(full, F.struct("record_id", "status", "headers", "payload")), ignorenulls=True).over(earlier))
    b, h = F.col(base), F.col("headers")
    old_tag, old_date = (F.col(f"{base}.headers")[n] for n in ("etag", "last-modified"))
    new_tag, new_date = h["etag"], h["last-modified"]
    both_tags, both_dates = old_tag.isNotNull() & new_tag.isNotNull(), old_date.isNotNull() & new_date.isNotNull()
    agree = F.when(both_tags, _strong(old_tag) == _strong(new_tag)).when(both_dates, F.trim(old_date) == F.trim(new_date))
    outcome = (
        F.when(F.col("kind").isNull() | (F.col("kind") != "revisit"), "full")
        .when(b.isNull() | F.col("canonical_uri").isNull() | F.col("date").isNull(), "no response")
        .when(agree.isNull(), "no validator")
        .when(agree, "resolved")
        .otherwise("mismatch")
    )
    done = F.col(head) == "resolved"
    changed = {"headers": F.when(done, merge_headers(F.col(f"{base}.headers"), h)).otherwise(h)}
    changed |= {c: F.when(done, F.col(f"{base}.{c}")).otherwise(F.col(c)) for c in ("status", "payload")}
    columns = [changed[c.lower()].alias(c) if c.lower() in changed else named(c) for c in records.columns]
    return found.withColumn(head, outcome).select(*columns, "canonical_uri", F.when(done, F.col(f"{base}.record_id")).alias("refers_to"), F.col(head).alias("outcome"))


def page_records(pages: DataFrame) -> DataFrame:
    """The archive that the pages table stands for: a full response of each page and a 304 of a later visit.

    The later visit asks for the same page under another spelling of its URL and
    brings, in turn by page_id, the entity tag, its weak form, the date of last
    change only, another entity tag, and no validator.
    """
    h = F.md5(F.col("html"))
    tag, changed = F.concat(F.lit('"'), F.substring(h, 1, 16), F.lit('"')), F.concat(F.lit("day "), F.col("page_id").cast("string"))
    turn = F.col("page_id") % 5
    some = F.map_filter(
        F.create_map(
            F.lit("ETag"), F.when(turn == 0, tag).when(turn == 1, F.concat(F.lit("W/"), tag)).when(turn == 3, F.lit('"other"')),
            F.lit("Last-Modified"), F.when(turn == 2, changed),
            F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Type"), F.lit("text/plain"),
        ),
        lambda k, v: v.isNotNull(),
    )
    first = pages.select("page_id", (2 * F.col("page_id")).alias("record_id"), F.col("url").alias("uri"), F.col("page_id").alias("date"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), changed, F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length(F.encode("html", "UTF-8")).cast("string")).alias("headers"), F.col("html").alias("payload"))
    again = pages.select("page_id", (2 * F.col("page_id") + 1).alias("record_id"), F.concat(F.upper(F.substring("url", 1, 4)), F.expr("substring(url, 5)"), F.lit("#again")).alias("uri"), (F.col("page_id") + 3).alias("date"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), some.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return first.union(again)


def as_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


ORACLE_SQL = rf"""
WITH records AS (
  SELECT page_id, 2 * page_id AS record_id, url AS uri, page_id AS date, 'response' AS kind, 200 AS status, '"' || substr(md5(html), 1, 16) || '"' AS etag, 'day ' || page_id AS modified, NULL AS cache, 'text/html' AS type, strlen(html) AS bytes, html AS payload FROM pages
  UNION ALL
  SELECT page_id, 2 * page_id + 1, upper(substr(url, 1, 4)) || substr(url, 5) || '#again', page_id + 3, 'revisit', 304,
    CASE page_id % 5 WHEN 0 THEN '"' || substr(md5(html), 1, 16) || '"' WHEN 1 THEN 'W/"' || substr(md5(html), 1, 16) || '"' WHEN 3 THEN '"other"' END, CASE WHEN page_id % 5 = 2 THEN 'day ' || page_id END, 'max-age=60', 'text/plain', NULL, NULL FROM pages),
split AS (SELECT *, lower(regexp_extract(uri, '{_URL}', 1)) AS s, lower(regexp_extract(uri, '{_URL}', 2)) AS h, regexp_extract(uri, '{_URL}', 3) AS p, list_sort(list_filter(string_split(regexp_extract(uri, '{_URL}', 4), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^{TRACKING}(=|$)'))) AS q FROM records),
canon AS (SELECT *, s || '://' || CASE s WHEN 'http' THEN regexp_replace(h, ':80$', '') ELSE regexp_replace(h, ':443$', '') END || CASE p WHEN '' THEN '/' ELSE p END || CASE len(q) WHEN 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS canonical_uri FROM split),
ranked AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical_uri ORDER BY date, kind, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM canon),
joined AS (SELECT r.*, b.etag AS etag_b, b.modified AS modified_b, b.type AS type_b, b.bytes AS bytes_b, b.payload AS payload_b,
  CASE WHEN r.kind = 'response' THEN 'full' WHEN r.base IS NULL THEN 'no response' WHEN r.etag IS NOT NULL THEN CASE WHEN regexp_replace(r.etag, '^W/', '') = b.etag THEN 'resolved' ELSE 'mismatch' END
       WHEN r.modified IS NOT NULL THEN CASE WHEN r.modified = b.modified THEN 'resolved' ELSE 'mismatch' END ELSE 'no validator' END AS outcome FROM ranked r LEFT JOIN canon b ON b.record_id = r.base)
SELECT page_id, record_id, uri, date, kind, CASE outcome WHEN 'resolved' THEN 200 ELSE status END AS status, CASE outcome WHEN 'resolved' THEN payload_b ELSE payload END AS payload, canonical_uri, CASE outcome WHEN 'resolved' THEN base END AS refers_to, outcome,
  CASE WHEN outcome = 'resolved' THEN array_to_string(list_filter(['cache-control: ' || cache, 'content-length: ' || bytes_b, 'content-type: ' || type_b, 'etag: ' || coalesce(etag, etag_b), 'last-modified: ' || coalesce(modified, modified_b)], lambda x: x IS NOT NULL), chr(10))
  ELSE array_to_string(list_filter(['cache-control: ' || cache, 'content-length: ' || bytes, 'content-type: ' || type, 'etag: ' || etag, 'last-modified: ' || modified], lambda x: x IS NOT NULL), chr(10)) END AS headers
FROM joined
"""
