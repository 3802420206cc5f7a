"""Landed sitemap bodies to locations."""

from __future__ import annotations

import itertools
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MAX_BYTES = 50 << 20
PARSED = "kind string, locations array<string>, lastmod_ratio double, parse_ok boolean"
_NOT_READ = {"kind": None, "locations": [], "lastmod_ratio": None, "parse_ok": False}


def _name(element) -> str:
    return element.tag.rpartition("}")[2].lower()


def _unpacked(body: bytes, url: str, content_type: str | None, cut: bool) -> bytes | None:
    if not (url.lower().endswith(".gz") or (content_type or "").lower().startswith("application/x-gzip")):
        return body
    stream = zlib.decompressobj(31)
    try:
        out = stream.decompress(body)
        out += b"" if cut else stream.flush()
    except zlib.error:
        return None
    return out if cut or stream.eof else None


def _entries(data: bytes, cut: bool):
    """The root's name and its complete children; of a document cut short, those before the cut."""
    parser = ET.XMLPullParser(["start", "end"])
    root, depth, children = None, 0, []
    try:
        parser.feed(data)
        if not cut:
            parser.close()
    except ET.ParseError:
        if not cut:
            return None, []
    try:
        for event, element in parser.read_events():
            depth += 1 if event == "start" else -1
            root = element if root is None else root
            if event == "end" and depth == 1:
                children.append(element)
    except ET.ParseError:
        if not cut:
            return None, []
    return (None if root is None else _name(root)), children


def parse_sitemap(body: bytes | None, url: str, content_type: str | None = None, cut: bool = False) -> dict:
    """Kind (urlset or index), locations and share of entries with lastmod; parse_ok is false for anything else."""
    data = _unpacked(bytes(body or b""), url or "", content_type, cut)
    if data is None or len(data) > MAX_BYTES:
        return _NOT_READ
    root, children = _entries(data, cut)
    wanted = {"urlset": "url", "sitemapindex": "sitemap"}.get(root)
    entries = [c for c in children if _name(c) == wanted]
    if wanted is None or (cut and not entries):
        return _NOT_READ
    fields = [{_name(f): (f.text or "").strip() for f in e} for e in entries]
    dated = sum(bool(f.get("lastmod")) for f in fields)
    return {"kind": "urlset" if root == "urlset" else "index", "locations": [f["loc"] for f in fields if f.get("loc")], "lastmod_ratio": round(dated / len(fields), 3) if fields else None, "parse_ok": True}


def read_sitemaps(landed: DataFrame) -> DataFrame:
    """``landed`` (site_id, url, body binary, content_type, truncated) with the columns of ``PARSED``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parse_sitemap(r.body, r.url, r.content_type, bool(r.truncated)) for r in b.itertuples()]
            yield pd.concat([b[["site_id", "url"]].reset_index(drop=True), pd.DataFrame(got, columns=["kind", "locations", "lastmod_ratio", "parse_ok"])], axis=1)

    return landed.select("site_id", "url", "body", "content_type", "truncated").mapInPandas(run, "site_id string, url string, " + PARSED)


def follow_indexes(declared: DataFrame, parsed: DataFrame, limit: int | None = 10) -> DataFrame:
    """(site_id, url, kind, locations, ..., beyond) of sitemaps reached from ``declared`` (site_id, url), the nearest ``limit`` of each site (None: all).

    Each round follows the indexes found by the last one, until nothing new is found; beyond says how many more files of the site were reached.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from weftscan.sources.shared import landed

    reached = last = landed(declared.select("site_id", "url", F.lit(0).alias("level")).distinct())
    for level in itertools.count(1):
        opened = parsed.where("kind = 'index'").join(last.select("site_id", "url"), ["site_id", "url"])
        last = landed(opened.select("site_id", F.explode("locations").alias("url")).distinct().join(reached, ["site_id", "url"], "left_anti").withColumn("level", F.lit(level)))
        if last.isEmpty():
            break
        reached = reached.unionByName(last) if level % 20 else landed(reached.unionByName(last))
    if limit is None:
        return reached.drop("level").withColumn("beyond", F.lit(0).cast("long")).join(parsed, ["site_id", "url"])
    ranked = reached.withColumn("k", F.row_number().over(Window.partitionBy("site_id").orderBy("level", "url"))).where(F.col("k") <= limit)
    more = reached.groupBy("site_id").agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0).cast("long")).alias("beyond"))
    return ranked.drop("k", "level").join(more, "site_id").join(parsed, ["site_id", "url"])
