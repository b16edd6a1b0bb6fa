"""JSON answers and probes in, metadata records out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "caption string, tags array<string>, objects array<string>, mood string, contains_text boolean, is_sensitive boolean, confidence double"
PROBE = "format struct<duration:string,size:string,bit_rate:string,format_name:string>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string>>"
# Names of keys in written metadata.
KEYS = {"caption": "XPComment", "tags": "Keywords", "rating": "Rating", "creator": "Artist", "copyright": "Copyright", "title": "Title", "subject": "Subject", "location": "Location", "city": "City", "country": "Country", "keywords": "Keywords", "description": "Description", "comment": "UserComment"}


def parse_model_answers(df: DataFrame, col: str = "answer") -> DataFrame:
    """df with parsed: the JSON of an answer (in a fence marked json, else in the first fence, closed or not, else bare), or what its prose gives: first line, quoted words or hashtags."""
    text = F.col(col)
    marked, fenced = F.get(F.split(text, "```json"), F.lit(1)), F.get(F.split(text, "```"), F.lit(1))
    data = F.from_json(F.coalesce(F.get(F.split(marked, "```"), F.lit(0)), fenced, text), ANSWER)
    quoted, tagged = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), F.regexp_extract_all(text, F.lit(r"#(\w+)"), F.lit(1))
    prose = F.struct(
        F.substring(F.get(F.split(text, "\n"), F.lit(0)), 1, 200).alias("caption"), F.slice(F.when(F.size(quoted) > 0, quoted).otherwise(tagged), 1, 10).alias("tags"), F.array().cast("array<string>").alias("objects"),
        F.lit("neutral").alias("mood"), F.lit(False).alias("contains_text"), F.lit(False).alias("is_sensitive"), F.lit(0.5).alias("confidence"),
    )
    return df.withColumn("parsed", F.when(data["caption"].isNotNull(), data).otherwise(prose))


def parse_probe(df: DataFrame, col: str = "probe") -> DataFrame:
    """df with duration, size, bit_rate, format, codec, width, height and fps of the first video stream; 0/0 gives no fps."""
    p = F.from_json(F.col(col), PROBE)
    video = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    rate = F.split(video["r_frame_rate"], "/")
    fps = F.try_divide(F.get(rate, F.lit(0)).try_cast("double"), F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0)))
    f = p["format"]
    return df.withColumns({"duration": f["duration"].try_cast("double"), "size": f["size"].try_cast("long"), "bit_rate": f["bit_rate"].try_cast("long"), "format": f["format_name"], "codec": video["codec_name"], "width": video["width"], "height": video["height"], "fps": fps})


def analysis_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def metadata_projection(df: DataFrame, scale: float = 10.0) -> DataFrame:
    """df with metadata: map of written keys. Caption to 1000 characters, up to 20 keywords, mood, and a rating of 0 to 5 from the score on its scale; no rating for none or zero."""
    score = F.col("aesthetic_score")
    rating = F.greatest(F.lit(0), F.least(F.lit(5), (score * 10 / scale / 2).cast("int")))
    pairs = F.array(
        F.when(F.col("caption") != "", F.struct(F.lit("caption").alias("k"), F.substring("caption", 1, 1000).alias("v"))),
        F.when(F.size("tags") > 0, F.struct(F.lit("keywords").alias("k"), F.array_join(F.slice("tags", 1, 20), ", ").alias("v"))),
        F.when(F.col("mood") != "", F.struct(F.lit("comment").alias("k"), F.concat(F.lit("Mood: "), "mood").alias("v"))),
        F.when((score != 0) & score.isNotNull(), F.struct(F.lit("rating").alias("k"), rating.cast("string").alias("v"))),
    )
    names = F.create_map(*(F.lit(x) for kv in KEYS.items() for x in kv))
    return df.withColumn("metadata", F.transform_keys(F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull())), lambda k, _: names[k]))


def verify_metadata(df: DataFrame) -> DataFrame:
    has = lambda *ks: F.coalesce(*[F.element_at("metadata", KEYS[k]).isNotNull() | F.lit(False) for k in ks])
    return df.withColumns({"has_description": has("caption"), "has_keywords": has("keywords"), "has_rating": has("rating")})
