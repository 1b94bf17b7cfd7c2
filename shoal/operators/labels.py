"""Per-cluster words, samples and label cards.

One job covers every cluster: word occurrences are exploded once, counted
with a map-side partial aggregate, and cut to the top ``n`` per cluster by a
``row_number() <= n`` filter, which Spark plans as a window group limit on
both sides of the shuffle -- a cluster holding a third of all rows never
sends more than ``n`` candidates per partition.  Nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions import text as TX

# ---------------------------------------------------------------------------
# Fixed values that must match the reference's behaviour.
#
# Japanese stopwords (simple list) dropped from the frequent-word counts.
STOPWORDS = [
    "の", "に", "は", "を", "た", "が", "で", "て", "と", "し", "れ", "さ",
    "ある", "いる", "も", "する", "から", "な", "こと", "として", "い", "や",
    "など", "なっ", "ない", "この", "ため", "その", "あっ", "よう", "また",
    "もの", "という", "あり", "まで", "られ", "なる", "へ", "か", "だ", "これ",
    "によって", "により", "おり", "より", "による", "ず", "なり", "られる",
    "において", "ば", "なかっ", "なく", "しかし", "について", "せ", "だっ",
    "その他", "及び", "できる", "できない", "等", "ほか", "以上", "以下",
    "場合", "必要", "対応", "実施", "実現", "推進", "取り組み", "取組",
    "目標", "達成", "向上", "強化", "徹底", "継続", "改善", "活動",
    "ます", "です", "ました", "でした", "ください", "します", "しました",
]
# Card texts.
NOISE_LABEL = "未分類（ノイズ）"
NOISE_DESCRIPTION = "HDBSCANによってクラスタに属さないと判定されたデータポイントです。"
LABEL_PREFIX = "クラスタ "                      # default label "クラスタ {id}"
LABEL_SEPARATOR = "・"                          # between the first three words
WORDS_SEPARATOR = "、"                          # between the first five words
DESCRIPTION_TEMPLATE = (
    "このクラスタは「{words}」などのキーワードを中心とした取り組み宣言で構成されています。"
    "共通する目的として{first}の推進・強化が挙げられ、"
    "組織的な改善や成果向上を目指す施策が集まっていると考えられます。"
    "（詳細な分析にはLLM APIの設定が必要です）"
)
EMPTY_DESCRIPTION = "このクラスタの特徴を分析中です。詳細な分析にはLLM APIの設定が必要です。"
RELABEL_FAILED_SUFFIX = " (v2)"                # "クラスタ {id} (v2)"
LABEL_SECTION = "【ラベル】"
DESCRIPTION_SECTION = "【特徴説明】"
# Prompt asking for a label and a description; {samples} are "- text" lines,
# {words} the frequent words joined by ", ".
LABEL_PROMPT = """以下は、企業の「取り組み宣言」テキストをクラスタリングした結果の一つです。

【サンプルテキスト】
{samples}

【頻出キーワード】
{words}

このクラスタを深く分析し、以下の形式で回答してください：

【ラベル】
このクラスタを端的に表す具体的なラベル（15〜25文字）。
「〜〜関連」「〜〜について」などの曖昧な表現は使わず、具体的な行動や目標を示すこと。
例：「省エネ設備への投資計画」「若手人材の育成プログラム」

【特徴説明】
このクラスタの本質を分析し、以下を含めて5〜8行で記述：

1. 共通する目的・意図：これらの宣言に共通する狙いや背景は何か
2. 具体的な取り組み内容：どのような施策・行動が含まれているか
3. 期待される効果・成果：これらの取り組みで何を達成しようとしているか
4. 推測される課題意識：なぜこのような宣言が集まったのか、背景にある課題は何か

単なるキーワードの羅列ではなく、分析的・洞察的な説明をしてください。

回答："""
# Prompt asking for a new label only, given the previous one.
RELABEL_PROMPT = """以下のテキストクラスタに、新しいラベルを付けてください。
前回のラベル「{previous}」とは異なる視点でお願いします。

【サンプルテキスト】
{samples}

【頻出語】
{words}

新しいラベル（15〜25文字程度の具体的な日本語。「〜〜関連」「〜〜について」などの曖昧な表現は避け、何をするのか/何であるかを明確に示すこと）："""
# Generation limits: full card, relabel.
LABEL_MAX_TOKENS = 800
RELABEL_MAX_TOKENS = 100
DESCRIPTION_FALLBACK_CHARS = 500
# ---------------------------------------------------------------------------

TOP_WORDS = 10
SAMPLE_TEXTS = 5
REPRESENTATIVES = 3
SAMPLE_CHARS = 200


def word_occurrences(df: DataFrame, text_col: str = "document_text", cluster_col: str = "cluster",
                     order_col: str = "record_id", pattern: str = TX.CJK_RUN,
                     min_length: int = 2, stopwords: list[str] | None = None,
                     words_col: str | None = None) -> DataFrame:
    """F9 + T10: one row per kept word occurrence ``(cluster, word, order, pos)``.

    With ``words_col`` the words are those of that array column (T11), already filtered.
    """
    sw = STOPWORDS if stopwords is None else stopwords
    src = df.select(F.col(cluster_col).alias("cluster"), F.col(order_col).alias("order"),
                    F.col(words_col or text_col).alias("_text"))
    words = F.col("_text") if words_col else TX.cjk_runs("_text", pattern)
    occ = src.select("cluster", "order", F.posexplode_outer(words).alias("pos", "word"))
    if words_col:
        return occ.where(F.col("word").isNotNull())
    # outer explode + null filter: an inner one makes the optimizer add a
    # size(...) > 0 filter that runs the regex a second time.
    keep = F.col("word").isNotNull() & (F.length("word") >= min_length)
    if sw:
        keep = keep & ~F.col("word").isin(sw)
    return occ.where(keep)


#: Positions that a record has room for where its id and a position make one number, and the number of a null id, before all others.
_PLACES, _NO_ID = 1 << 32, -(1 << 63) - 1


def word_counts(df: DataFrame, order_col: str = "record_id", **kw) -> DataFrame:
    """Occurrences of each word per cluster, with its first position.

    ``first`` is ``(order, pos)`` of the first occurrence in record order; it
    breaks count ties the way an insertion-ordered counter does.  Where ids are
    whole numbers, the two are compared as one number: Spark keeps the least of a
    number in a hash table, but sorts all occurrences for the least of a struct.
    """
    kind = df.schema[order_col].dataType
    if not isinstance(kind, T.IntegralType):
        return word_occurrences(df, order_col=order_col, **kw).groupBy("cluster", "word").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("order", "pos")).alias("first"))

    def whole(n: int) -> Column:
        return F.lit(str(n)).cast("decimal(20,0)")
    base = (F.coalesce(F.col(order_col).cast("decimal(20,0)"), whole(_NO_ID)) * whole(_PLACES)).cast("decimal(30,0)")
    occ = word_occurrences(df.withColumn("_base", base), order_col="_base", **kw)
    counts = occ.groupBy("cluster", "word").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("order") + F.col("pos")).alias("_at"))
    pos = F.pmod(F.col("_at"), whole(_PLACES))
    record = F.nullif(((F.col("_at") - pos) / whole(_PLACES)).cast("decimal(20,0)"), whole(_NO_ID)).cast(kind)
    return counts.select("cluster", "word", "n", F.struct(record.alias("order"), pos.cast("int").alias("pos")).alias("first"))


def top_words(df: DataFrame, top_n: int = TOP_WORDS, tie: str = "first", **kw) -> DataFrame:
    """The ``top_n`` most frequent words per cluster as ``(cluster, rank, word, n)``.

    ``tie='first'`` orders equal counts by first occurrence, ``tie='word'`` by the word.
    """
    counts = word_counts(df, **kw)
    order = [F.col("n").desc(), F.col("first").asc(), F.col("word").asc()] if tie == "first" \
        else [F.col("n").desc(), F.col("word").asc()]
    w = Window.partitionBy("cluster").orderBy(*order)
    return (counts.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= top_n)
            .select("cluster", F.col("rank").cast("int").alias("rank"), "word", "n"))


def word_lists(df: DataFrame, top_n: int = TOP_WORDS, **kw) -> DataFrame:
    """Top words packed per cluster: ``(cluster, frequent_words ARRAY<STRING>)`` (<= top_n each)."""
    tw = top_words(df, top_n=top_n, **kw)
    return tw.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"])
        .alias("frequent_words"))


def sample_texts(df: DataFrame, n: int = SAMPLE_TEXTS, text_col: str = "document_text",
                 cluster_col: str = "cluster", order_col: str = "record_id",
                 clip_chars: int = SAMPLE_CHARS) -> DataFrame:
    """First ``n`` texts per cluster in record order, clipped (P7): ``(cluster, sample_texts)``."""
    first = (df.select(F.col(cluster_col).alias("cluster"), F.col(order_col).alias("order"),
                       TX.clip(F.coalesce(F.col(text_col), F.lit("")), clip_chars).alias("t"))
             .withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy("order")))
             .where(F.col("rn") <= n))
    return first.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "t"))), lambda s: s["t"])
        .alias("sample_texts"))


def representatives(samples: Column, k: int = REPRESENTATIVES) -> Column:
    """The first ``k`` sample texts."""
    return F.slice(samples, 1, k)


def default_label(cluster: Column) -> Column:
    return F.concat(F.lit(LABEL_PREFIX), cluster.cast("string"))


def fallback_label(cluster: Column, words: Column) -> Column:
    """L1: the first three (two, one) words joined by ・; no words -> クラスタ {id}."""
    w = F.coalesce(words, F.array().cast("array<string>"))
    return F.when(F.size(w) == 0, default_label(cluster)).otherwise(
        F.array_join(F.slice(w, 1, 3), LABEL_SEPARATOR))


def fallback_description(words: Column) -> Column:
    """L2: template over the first five words and the first word."""
    w = F.coalesce(words, F.array().cast("array<string>"))
    head, tail = DESCRIPTION_TEMPLATE.split("{words}")
    mid, end = tail.split("{first}")
    return F.when(F.size(w) == 0, F.lit(EMPTY_DESCRIPTION)).otherwise(
        F.concat(F.lit(head), F.array_join(F.slice(w, 1, 5), WORDS_SEPARATOR), F.lit(mid),
                 F.element_at(w, 1), F.lit(end)))


CARD_SCHEMA = ("cluster INT, label STRING, description STRING, representative_texts ARRAY<STRING>, "
               "frequent_words ARRAY<STRING>, count BIGINT")


def cluster_cards(df: DataFrame, text_col: str = "document_text", cluster_col: str = "cluster",
                  order_col: str = "record_id", top_n: int = TOP_WORDS, n_samples: int = SAMPLE_TEXTS,
                  pattern: str = TX.CJK_RUN, tie: str = "first",
                  with_samples: bool = False, words_col: str | None = None,
                  stopwords: list[str] | None = None) -> DataFrame:
    """L3 + L4: a card for every cluster (fallback label/description; noise card for -1).

    Three per-cluster aggregates joined on ``cluster``; each side has one row
    per cluster, so the joins are small whatever the record count.
    """
    counts = df.groupBy(F.col(cluster_col).cast("int").alias("cluster")).agg(F.count(F.lit(1)).alias("count"))
    words = word_lists(df, top_n=top_n, text_col=text_col, cluster_col=cluster_col,
                       order_col=order_col, pattern=pattern, tie=tie, words_col=words_col, stopwords=stopwords)
    samples = sample_texts(df, n=n_samples, text_col=text_col, cluster_col=cluster_col,
                           order_col=order_col)
    j = counts.join(words, "cluster", "left").join(samples, "cluster", "left")
    wl = F.coalesce(F.col("frequent_words"), F.array().cast("array<string>"))
    noise = F.col("cluster") == -1
    cols = [
        F.col("cluster"),
        F.when(noise, F.lit(NOISE_LABEL)).otherwise(fallback_label(F.col("cluster"), wl)).alias("label"),
        F.when(noise, F.lit(NOISE_DESCRIPTION)).otherwise(fallback_description(wl)).alias("description"),
        representatives(F.coalesce(F.col("sample_texts"), F.array().cast("array<string>"))).alias(
            "representative_texts"),
        wl.alias("frequent_words"),
        F.col("count"),
    ]
    if with_samples:
        cols.append(F.coalesce(F.col("sample_texts"), F.array().cast("array<string>")).alias("sample_texts"))
    return j.select(*cols)


# -- L5-L8: prompts, generation through a user callable, parsing, relabel ----

def _fill(template: str, values: dict[str, Column]) -> Column:
    """Concatenate the template's literal parts with Column values for {name} slots."""
    out = []
    for part in re.split(r"(\{\w+\})", template):
        if part.startswith("{") and part.endswith("}") and part[1:-1] in values:
            out.append(values[part[1:-1]])
        elif part:
            out.append(F.lit(part))
    return F.concat(*out)


def _slots(samples: Column, words: Column) -> dict[str, Column]:
    return {"samples": F.array_join(F.transform(samples, lambda t: F.concat(F.lit("- "), t)), "\n"),
            "words": F.array_join(words, ", ")}


def label_prompts(cards: DataFrame, template: str = LABEL_PROMPT) -> DataFrame:
    """One prompt per non-noise cluster from <=5 samples and <=10 words.

    ``cards`` must carry ``sample_texts`` (``cluster_cards(..., with_samples=True)``).
    """
    c = cards.where(F.col("cluster") != -1)
    return c.select("cluster", _fill(template, _slots(F.col("sample_texts"), F.col("frequent_words")))
                    .alias("prompt"))


def relabel_prompts(cards: DataFrame, clusters: list[int], template: str = RELABEL_PROMPT) -> DataFrame:
    """L8 (first half): prompts for the chosen clusters, with the previous label."""
    c = cards.where(F.col("cluster").isin(clusters))
    slots = _slots(F.col("sample_texts"), F.col("frequent_words")) | {"previous": F.col("label")}
    return c.select("cluster", _fill(template, slots).alias("prompt"))


def generate(prompts: DataFrame, make_generator: Callable[[], Callable[[str, int], str]],
             max_tokens: int = LABEL_MAX_TOKENS) -> DataFrame:
    """Run a user model over prompt rows on the executors.

    ``make_generator()`` runs once per task and returns ``fn(prompt, max_tokens)``.  A
    failing call yields a null ``response`` and the error text; callers fall back per row.
    The result is lazy: keep it (checkpoint) before using it twice.
    """
    schema = T.StructType(prompts.schema.fields + [
        T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches):
        fn = make_generator()
        for pdf in batches:
            responses, errors = [], []
            for p in pdf["prompt"]:
                try:
                    responses.append(fn(p, max_tokens))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - a failed call becomes a fallback row
                    responses.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(response=pd.Series(responses, dtype=object),
                             error=pd.Series(errors, dtype=object))

    return prompts.mapInPandas(run, schema)


def parse_response(cluster: Column, response: Column) -> tuple[Column, Column]:
    """【ラベル】 and 【特徴説明】 sections; defaults クラスタ {id} / first 500 chars."""
    lab = TX.strip_ws(F.regexp_extract(response, "(?s)" + LABEL_SECTION + TX.WS_CLASS + r"*(.+?)(?=【|$)", 1))
    desc = TX.strip_ws(F.regexp_extract(response, "(?s)" + DESCRIPTION_SECTION + TX.WS_CLASS + r"*(.+?)(?=【|$)", 1))
    label = F.when(lab != "", lab).otherwise(default_label(cluster))
    description = F.when(desc != "", desc).otherwise(
        F.substring(TX.strip_ws(response), 1, DESCRIPTION_FALLBACK_CHARS))
    return label, description


def generated_cards(cards: DataFrame, make_generator: Callable[[], Callable[[str, int], str]] | None) -> DataFrame:
    """L4 with a generator: parsed label/description, per-row fallback on failure."""
    if make_generator is None:
        return cards
    gen = generate(label_prompts(cards), make_generator, LABEL_MAX_TOKENS)
    lab, desc = parse_response(F.col("cluster"), F.col("response"))
    parsed = gen.select("cluster", F.when(F.col("response").isNotNull(), lab).alias("g_label"),
                        F.when(F.col("response").isNotNull(), desc).alias("g_description"))
    j = cards.join(parsed, "cluster", "left")
    return j.select(
        *[F.coalesce("g_label", "label").alias("label") if c == "label"
          else F.coalesce("g_description", "description").alias("description") if c == "description"
          else F.col(c) for c in cards.columns])


def relabel(cards: DataFrame, clusters: list[int],
            make_generator: Callable[[], Callable[[str, int], str]] | None) -> DataFrame:
    """New labels for the chosen clusters; other card fields kept (Q9 repaired).

    Without a generator the cards are returned unchanged; a failed call gives
    ``クラスタ {id} (v2)``.
    """
    if make_generator is None:
        return cards
    gen = generate(relabel_prompts(cards, clusters), make_generator, RELABEL_MAX_TOKENS)
    new = gen.select("cluster", F.when(F.col("response").isNotNull(), TX.strip_ws(F.col("response")))
                     .otherwise(F.concat(default_label(F.col("cluster")), F.lit(RELABEL_FAILED_SUFFIX)))
                     .alias("new_label"))
    j = cards.join(new, "cluster", "left")
    return j.select(*[F.coalesce("new_label", "label").alias("label") if c == "label" else F.col(c)
                      for c in cards.columns])
