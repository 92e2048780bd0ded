"""Per-item snapshot documents to row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = (
    "array<struct<id:string,start:double,end:double,text:string,language:string,speakerLabel:string,"
    "characterId:string,mixed:boolean,locked:boolean,was_split:boolean,q:double,origin:string,note:string>>"
)
TURN = "array<struct<start:double,end:double,label:string>>"


def explode_snapshots(docs: DataFrame, kind: str = "segments") -> DataFrame:
    """Rows of a JSON array column; a broken column falls back to ``data``, then to none.

    ``docs``: item_id, the JSON column named ``kind`` and a JSON object ``data``.
    """
    shape = SEGMENT if kind == "segments" else TURN
    own = F.when(F.ltrim(F.col(kind)).startswith("["), F.from_json(F.col(kind), shape))
    spare = F.from_json(F.get_json_object("data", f"$.{kind}"), shape)
    rows = docs.select("item_id", F.posexplode(F.coalesce(own, spare, F.array().cast(shape))).alias("ord", "r"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    if kind != "segments":
        return rows.select("item_id", "ord", ms("r.start").alias("start_ms"), ms("r.end").alias("end_ms"), "r.label")
    no = F.lit(False)
    return rows.select(
        "item_id", "ord", F.col("r.id").alias("seg_id"), ms("r.start").alias("start_ms"), ms("r.end").alias("end_ms"),
        F.col("r.text").alias("text"), F.col("r.language").alias("language"), F.col("r.speakerLabel").alias("speaker_label"),
        F.col("r.characterId").alias("character_id"), F.coalesce("r.mixed", no).alias("mixed"),
        F.coalesce("r.locked", no).alias("locked"), F.coalesce("r.was_split", no).alias("was_split"),
        F.col("r.q").alias("q"), F.col("r.origin").alias("origin"), F.col("r.note").alias("note"),
    )
