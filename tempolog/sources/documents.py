"""Catalog documents, favorites, planned lists and other text that people and services write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

API = "data struct<groups: array<struct<title: string, major: string, entries: array<struct<id: string, name: string, artist: string, dancer: string, playerCount: string, disablePublic: string>>>>>"
CACHE = (
    "id string, category string, title string, titleSpell string, playerIndex string, volume string, start string, end string, flip string, skipRandom string, checksum string, url string, urlForQuest string"
)
FAVORITES = "WannaFavorite:"


def flatten_catalog(documents: DataFrame, place: str | None = None) -> DataFrame:
    """Songs of catalog documents (column value): public entries, of an id the first, by id.

    Several documents come in the order of their column ``place``, so a large catalog need not be one document.
    """
    order = F.lit(0) if place is None else F.col(place)
    parsed = documents.select(order.alias("d"), F.from_json("value", API)["data"]["groups"].alias("groups"))
    groups = parsed.select("d", F.posexplode("groups").alias("g", "grp"))
    entries = groups.select("d", "g", "grp.title", "grp.major", F.posexplode("grp.entries").alias("e", "entry"))
    songs = entries.filter(~text.truthy(F.col("entry.disablePublic"))).select(
        "d", "g", "e", text.to_int(F.col("entry.id")).alias("id"), F.coalesce("entry.name", F.lit("")).alias("name"), F.coalesce("entry.artist", F.lit("")).alias("artist"), F.coalesce("entry.dancer", F.lit("")).alias("dancer"),
        text.to_int(F.col("entry.playerCount"), 0).alias("player_count"), F.col("title").alias("song_group"), "major",
    )
    first = F.row_number().over(Window.partitionBy("id").orderBy("d", "g", "e"))
    return songs.filter("id is not null").withColumn("__row", first).filter("__row = 1").drop("__row", "d", "g", "e").orderBy("id")


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Songs of a cache: one ``metadata.json`` per folder, whose name is the id where the file has none; bad files are skipped."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").text(folder)
    named = files.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("updated_at"))
    parsed = named.withColumns({"m": F.from_json("value", CACHE), "folder": F.element_at(F.split("path", "/"), -2)})
    numbered = parsed.withColumn("id", F.coalesce(text.to_int(F.col("m.id")), text.to_int(F.col("folder"))))
    flag = [text.truthy(F.col(f"m.{c}")).alias(n) for c, n in (("flip", "flip"), ("skipRandom", "skip_random"))]
    return numbered.filter("id is not null and m is not null and value rlike '^\\\\s*\\\\{'").select(
        "id", F.coalesce("m.title", F.lit("")).alias("title"), text.to_int(F.col("m.category")).alias("category"), text.to_float(F.col("m.volume")).alias("volume"), text.to_float(F.col("m.start")).alias("start_seconds"),
        text.to_float(F.col("m.end")).alias("end_seconds"), *flag, F.coalesce("m.checksum", F.lit("")).alias("checksum"), F.coalesce("m.url", F.lit("")).alias("url"), "path", "updated_at",
    )


def read_favorites(spark: SparkSession, path: str) -> DataFrame:
    """external_id, copies of a favorites file: one id a line, or a prefix and a comma list.

    An empty place, or one with space inside an id, is an error.
    """
    body = F.regexp_replace("value", "^﻿", "")
    listed = F.ltrim(body).startswith(FAVORITES)
    commas = F.split(text.strip(F.regexp_replace(F.ltrim(body), f"^{FAVORITES}", "")), ",")
    lines = F.split(F.regexp_replace(body, r"\r?\n$", ""), r"\r?\n")
    ids = spark.read.option("wholetext", True).text(path).select(F.explode(F.when(listed, commas).otherwise(lines)).alias("raw"))
    clean = text.strip(F.col("raw"))
    bad = (clean == "") | clean.rlike(r"\s")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not one track id: "), "raw"))).otherwise(clean)
    return ids.select(checked.alias("external_id")).groupBy("external_id").agg(F.count(F.lit(1)).alias("copies"))


#: Stands before each reference of a line, once they have been found.
_MARK = "\u001e"
_COUNT = r"(?:\d+\s*[.。]\s*)?"


def _marked_parts(line: Column, before: str, reference: str) -> Column:
    """What begins with a reference: the line is cut in front of each, together with what may stand ``before`` it."""
    return F.filter(F.split(F.regexp_replace(line, before + f"(?={reference})", _MARK), _MARK), lambda part: part.rlike("^" + reference))


def _entry(system: Column, number: Column, label: Column) -> Column:
    return F.struct(system.cast("string").alias("system_key"), F.trim(number).alias("external_id"), F.trim(label).alias("label"))


def _named_entries(line: Column) -> Column:
    """``system:id label``, several to a line, each perhaps counted."""
    def read(part: Column) -> Column:
        reference = F.substring_index(part, " ", 1)
        colon = F.instr(reference, ":")
        return _entry(F.lower(F.left(reference, colon - 1)), F.substr(reference, colon + 1), F.substr(part, F.length(reference) + 1))

    spaced = F.regexp_replace(line, r"\s", " ")
    return F.transform(_marked_parts(spaced, r"(?<!\S)" + _COUNT, r"[A-Za-z][A-Za-z0-9_-]*:\S"), read)


def _dotted_entries(line: Column, system: Column) -> Column:
    """``id. label``, several to a line; a number without label in front of another one only counts."""
    def read(part: Column) -> Column:
        number = F.regexp_extract(part, r"^\d+", 0)
        return _entry(system, number, F.substr(part, F.length(number) + 2))

    found = F.transform(_marked_parts(line, r"(?<![^\s?？|])", r"\d+[.、)]"), lambda part: F.regexp_replace(part, r"[\s?？|]+$", ""))
    return F.transform(F.filter(found, lambda part, k: (k == F.size(found) - 1) | part.rlike(r"^\d+[.、)]\s*\S")), read)


def _spaced_entries(line: Column, system: Column) -> Column:
    """``id label`` behind a bullet or a count; no entries if the line is not of that kind."""
    bare = F.regexp_replace(F.regexp_replace(line, r"^[-*]\s*", ""), r"^\d+\s+[.、)]\s*", "")
    words = F.split(bare, r"\s+", 2)
    return F.when((F.size(words) == 2) & words[0].rlike(r"^\d+$"), F.array(_entry(system, words[0], words[1])))


def planned_entries(lines: DataFrame, default_system: str | None = None) -> DataFrame:
    """Entries of planned lists (source_file, line_number, value): the date of their heading, reference, label and ordinal.

    A line under a heading names songs as ``system:id label``, as ``id. label``, as ``id label``, or, if
    none of these, is a label alone.
    """
    line = text.strip(F.regexp_replace("value", "^﻿", ""))
    date = F.when(line.rlike(r"^#*\s*\d{4}-\d{2}-\d{2}$"), F.regexp_extract(line, r"(\d{4}-\d{2}-\d{2})$", 1).try_cast("date"))
    dated = lines.select("source_file", "line_number", line.alias("line"), date.alias("__date")).filter("line <> ''")
    past = Window.partitionBy("source_file").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    under = dated.withColumn("played_date", F.last("__date", ignorenulls=True).over(past)).filter("__date is null and played_date is not null")
    system = F.lit(default_system.strip().lower() if default_system else None).cast("string")

    said = F.col("line")
    named, dotted = _named_entries(said), _dotted_entries(said, system)
    alone = F.array(F.struct(F.lit(None).cast("string").alias("system_key"), F.lit(None).cast("string").alias("external_id"), said.alias("label")))
    found = F.when(F.size(named) > 0, named).when(F.size(dotted) > 0, dotted).otherwise(F.coalesce(_spaced_entries(said, system), alone))
    spread = under.select("source_file", "line_number", "played_date", F.posexplode(found).alias("k", "r"))
    turn = F.row_number().over(Window.partitionBy("source_file", "played_date").orderBy("line_number", "k"))
    return spread.select("source_file", "played_date", "r.*", turn.alias("ordinal"))


def previews(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".md", ".txt"), most: int = 100, lines: int = 6) -> DataFrame:
    """name, size and first non-blank lines of a folder's lists."""
    glob = "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    shown = F.slice(F.filter(F.transform(F.split(F.decode("content", "UTF-8"), r"\r?\n"), F.trim), lambda x: x != ""), 1, lines)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), shown.alias("lines")).orderBy("name").limit(most)


def ground_truth(lines: DataFrame) -> DataFrame:
    """time, external_id, note of lines ``HH:MM id (note)``."""
    pattern = r"^\s*(\d{1,2}:\d{2})\s+(\d+)\s*(?:\((.*)\))?\s*$"
    part = [F.regexp_extract("value", pattern, k) for k in (1, 2, 3)]
    return lines.filter(F.col("value").rlike(pattern)).select(F.lpad(part[0], 5, "0").alias("time"), part[1].alias("external_id"), F.nullif(part[2], F.lit("")).alias("note"))
