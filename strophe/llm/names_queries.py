"""Queries of problem 4: variant spellings of names typed by people."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from strophe.llm.linking import link_spellings
from strophe.llm.naming import Lexicon, Rule, parse_body, parse_singer, parse_song
from strophe.llm.readings import Readings
from strophe.operators.skew import join_split
from strophe.session import cut

# What is said beside names in these tables.
WORDS = Lexicon(
    unknown=frozenset(
        "佚名 无名氏 未署名 未名 待定 无 不详 未详 无名 无题 未知 不明 众人 集体 群众 待考 "
        "unknown anonymous untitled various null none nan na n/a - ?".split()
    ),
    genres=("短调", "长调", "田歌", "船歌", "渔歌", "茶歌", "酒歌", "山歌", "情歌", "牧歌", "小调", "号子", "童谣", "民歌", "小曲", "folk song", "folksong"),
    endings=("小唱", "号子", "xiaochang", "hao子", "haozi", "调", "谣", "曲"),
    endings_by_syllable=(("xiao", "chang"), ("hao", "子"), ("hao", "zi"), ("diao",), ("yao",), ("qu",)),
    before=("民歌",),
    notes=("片段", "选段", "节选", "全曲", "完整版", "现场版", "现场", "清唱", "另一唱法", "live", "excerpt", "fragment"),
    roles=("演唱", "领唱", "独唱", "对唱", "合唱", "伴唱", "主唱", "老师", "先生", "女士", "歌手", "singer", "vocal", "vocals"),
    other_name=("艺名", "人称", "又名", "原名", "本名", "别名", "外号", "a.k.a.", "aka", "stage name"),
    suffixes=r"(?:\s*-\s*topic|\s*(?:官方|official)\s*(?:频道|账号|channel)?)+$",
    kinds=(
        ("archive", ("声像档案馆", "声像馆", "sound archive", "sa")),
        ("collection", ("音乐收藏", "乐藏", "music collection", "mc")),
        ("fieldclub", ("采风社", "采风", "field recording club", "frc")),
        ("hall", ("文化馆", "文馆", "culture hall", "ch")),
        ("troupe", ("民间艺术团", "民艺团", "folk art troupe", "fat")),
        ("choir", ("民歌合唱团", "民歌团", "folk song choir", "fsc")),
    ),
)

KINDS = {
    "singer": (partial(parse_singer, lex=WORDS), Rule(short_first=True, cosine=0.15)),
    "song_name": (partial(parse_song, lex=WORDS), Rule(syllable_edits=2, letters=5)),
    "channel": (partial(parse_body, lex=WORDS), Rule(turned=False, letters=3)),
}


def distinct_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """``(field, value)`` of all present values, made distinct before anything else is done with them."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return df.select(F.explode(cells).alias("c")).select("c.field", "c.value").where("value is not null").distinct()


def entities(spark: SparkSession, d: str) -> DataFrame:
    rec = spark.read.parquet(f"{d}/recordings.parquet")
    readings = Readings.load(spark.read.parquet(f"{d}/char_forms.parquet"))
    return link_spellings(distinct_values(rec, list(KINDS)), KINDS, readings)


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct spelling with its entity and the number of spellings of that entity."""
    e = entities(spark, d)
    n = e.groupBy("field", "entity").agg(F.count("*").alias("spellings"))
    return e.join(n, ["field", "entity"]).select("field", "value", "entity", "spellings")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of spellings of each entity, expanded from its members at the very end."""
    e = cut(entities(spark, d))
    a, b = e.select("field", "entity", F.col("value").alias("name_a")), e.select("field", "entity", F.col("value").alias("name_b"))
    return join_split(a, b, ["field", "entity"]).where("name_a < name_b").select("field", "name_a", "name_b")


QUERIES = {"p4_found": p4_found, "p4_entities": p4_entities}
SQL: dict[str, str] = {}
