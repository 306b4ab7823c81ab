"""Keyword sentiment of texts, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keyword lists of the reference behaviour.
BULLISH = [
    "上涨", "利好", "突破", "反弹", "增长", "创新高", "放量", "强势", "提振", "超预期", "牛市", "拉升", "涨幅", "盈利", "向上", "看涨",
    "做多", "增持", "买入", "推荐", "景气", "复苏", "扩张", "回升", "改善", "加速", "红盘", "领涨", "上扬", "飙涨", "走强",
]
BEARISH = [
    "下跌", "利空", "破位", "回调", "下滑", "创新低", "缩量", "弱势", "拖累", "不及预期", "熊市", "暴跌", "跌幅", "亏损", "向下", "看跌",
    "做空", "减持", "卖出", "回避", "衰退", "收缩", "低迷", "回落", "恶化", "减速", "绿盘", "领跌", "下挛", "重挛", "走弱",
]


def hits(text: Column, words: list[str]) -> Column:
    """Number of distinct words the text contains."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def score(text: Column, up: list[str] = BULLISH, down: list[str] = BEARISH) -> Column:
    """Share of the keywords found that are positive; 0.5 for none, null or empty."""
    pos, neg = hits(text, up), hits(text, down)
    return F.when(text.isNull() | (pos + neg == 0), 0.5).otherwise(pos / (pos + neg))


def index(texts: DataFrame | None, columns: tuple[str, ...] = ("title", "body"), up: list[str] = BULLISH, down: list[str] = BEARISH) -> DataFrame | None:
    """One row (sentiment): mean score over all non-null texts of the columns that exist; 0.5 without any."""
    if texts is None:
        return None
    have = [c for c in columns if c in texts.columns]
    if not have:
        return texts.sparkSession.createDataFrame([(0.5,)], "sentiment double")
    rows = texts.select(F.explode(F.array(*have)).alias("t")).where("t is not null")
    return rows.agg(F.coalesce(F.avg(score(F.col("t"), up, down)), F.lit(0.5)).alias("sentiment"))
