"""Where a file should go: text patterns, pictures of charts, file names, learned rules, and the cascade."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.display import exif_year
from ..functions.paths import _c, category_of_folder, is_document, is_screen_size


# --- text patterns ------------------------------------------------------------------------------
_NOT_FIXED = re.compile(r"(?:\\[bsd]|\[[^\]]*\]|[^\[\]\\](?=[?*{])|\.)(?:[+*?]|\{[^}]*\})?")


def _alternatives(pattern: str) -> list[str]:
    """The parts between bars outside of groups."""
    return re.findall(r"(?:\([^()]*\)|[^|()])+", pattern)


def _longest_run(alt: str) -> str:
    return max(_NOT_FIXED.sub("\0", alt).split("\0"), key=len)


def _needed_words(pattern: str) -> list[str] | None:
    """For every alternative the longest run of letters a text must hold, outside of groups or, if there is none, one for
    each alternative of a group that can't be left out; None if one has no such run."""
    words = []
    for alt in _alternatives(pattern):
        runs = [_longest_run(re.sub(r"\([^()]*\)[?*]?", "\0", alt))]
        group = re.search(r"\((?!\?)([^()]*)\)(?![?*{])", alt)
        if len(runs[0]) < 2 and group:
            runs = [_longest_run(x) for x in group[1].split("|")]
        words += runs
    return words if all(len(w) >= 2 for w in words) else None


_W = "[0-9A-Za-z_]"
_ASCII = {r"\b": f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))", r"\d": "[0-9]", r"\s": r"[\t\n\f\r ]", "s": "[s\u017f]"}


def _in_ascii(pattern: str) -> str:
    """The pattern with word boundaries, digits and blanks of ASCII alone. A long s is an s, but no letter of a word."""
    def put(m: re.Match) -> str:
        return m[0].replace("s", "s\u017f") if m[0].startswith("[") else _ASCII.get(m[0], m[0])

    return re.sub(r"\\.|\[[^\]]*\]|s", put, pattern)


_STARTS = re.compile(r"\\b([a-z]|\[[a-z]+\])")
_ENDS = re.compile(r"([a-z]|\\d\{1,2\})\\b")


def _without_long_s(pattern: str) -> str:
    """`_in_ascii` for texts without a long s: a boundary beside a letter of ASCII is looked at on its other side alone,
    and after the letter, as few places have that letter."""
    pattern = _ENDS.sub(rf"\1(?!{_W})", pattern)
    pattern = _STARTS.sub(rf"\1(?<!{_W}\1)", pattern)
    return re.sub(r"\\.|\[[^\]]*\]", lambda m: _ASCII.get(m[0], m[0]), pattern)


def _search(t: Column, pattern: str, ascii_only: bool = False) -> Column:
    """The pattern found in t. A substring test for what each alternative cannot do without comes first:
    most texts hold none of it, and it is far cheaper than a search."""
    plain = t.rlike("(?d)" + _without_long_s(pattern) if ascii_only else "(?dU)" + pattern)
    words = _needed_words(pattern)
    if words is not None:
        found = F.lit(False)
        for w in words:
            found = found | t.contains(w)
        plain = found if words == pattern.split("|") else found & plain
    return F.when(t.contains("\u017f"), t.rlike("(?d)" + _in_ascii(pattern))).otherwise(plain) if ascii_only else plain


def folded(text, ascii_only: bool = False) -> Column:
    """Lower case, with the two letters that fold onto i and s; needs no case folding when searched. With ascii_only
    the long s is left to the search, a dotless i is no i, and a capital with a dot loses it."""
    if ascii_only:
        return F.lower(F.when(_c(text).contains("\u0130"), F.translate(_c(text), "\u0130", "i")).otherwise(_c(text)))
    t = F.lower(_c(text))
    odd = t.contains("\u0131") | t.contains("\u017f")
    return F.when(odd, F.translate(t, "\u0131\u017f", "is")).otherwise(t)


def keyword_hits(t: Column, ascii_only: bool = False) -> dict[str, Column]:
    """Number of patterns of each category found in a folded text."""
    return {
        cat: sum((F.coalesce(_search(t, p, ascii_only), F.lit(False)).cast("int") for p in pats), F.lit(0))
        for cat, pats in K.KEYWORD_PATTERNS.items()
    }


def with_keyword_category(df: DataFrame, text: str = "text", ascii_only: bool = False) -> DataFrame:
    """Adds keyword_hits and keyword_category: the category with most hits, the earlier one of equals. Words, digits and
    blanks are those of Unicode, or, with ascii_only, those of ASCII, as engines like RE2 see them."""
    df = df.withColumn("_t", folded(text, ascii_only))
    named = [F.struct(n.alias("hits"), F.lit(-i).alias("place"), F.lit(cat).alias("category"))
             for i, (cat, n) in enumerate(keyword_hits(F.col("_t"), ascii_only).items())]
    df = df.withColumn("_best", F.array_max(F.array(*named)))
    hit = F.col("_best.hits") > 0
    return df.withColumn("keyword_hits", F.col("_best.hits")).withColumn(
        "keyword_category", F.when(hit, F.col("_best.category"))).drop("_best", "_t")


# --- pictures -----------------------------------------------------------------------------------
def chart_pictures(pixels: DataFrame) -> DataFrame:
    """(asset_id, is_chart) out of (asset_id, r, g, b): some red, some green, mostly dark."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")

    def share(cond: Column) -> Column:
        return F.avg(cond.cast("int"))

    red = share((r > g + 30) & (r > b + 30))
    green = share((g > r + 30) & (g > b + 30))
    dark = share(F.floor(0.299 * r + 0.587 * g + 0.114 * b) < 30)
    return pixels.groupBy("asset_id").agg(((red > 0.05) & (green > 0.05) & (dark > 0.40)).alias("is_chart"))


def filename_category(name) -> Column:
    """Category of the first file name pattern that fits."""
    out = None
    for pattern, category in K.FILENAME_PATTERNS:
        cond = _c(name).rlike("(?iudU)" + pattern)
        out = F.when(cond, category) if out is None else out.when(cond, category)
    return out


def picture_hint(name, width, height, exif_original, exif_modified) -> Column:
    """struct(category, folder, confidence) from name, dimensions and date, or null."""
    by_name = filename_category(name)
    year = exif_year(exif_original, exif_modified)

    def hint(category, folder, confidence) -> Column:
        return F.struct(category.alias("category"), folder.alias("folder"), F.lit(confidence).alias("confidence"))

    dated = F.concat(F.lit("Photos/"), year.cast("string"))
    return (
        F.when((by_name == "Photos") & year.isNotNull(), hint(F.lit("Photos"), dated, 0.85))
        .when(by_name.isNotNull(), hint(by_name, by_name, 0.75))
        .when(is_screen_size(width, height), hint(F.lit("Screenshots"), F.lit("Screenshots"), 0.60))
        .when(year.isNotNull(), hint(F.lit("Photos"), dated, 0.55))
    )


# --- learned rules and folder usage -------------------------------------------------------------
def current_rules(log: DataFrame) -> DataFrame:
    """Last folder written per pattern, out of (pattern, folder, updated_at, seq)."""
    return log.groupBy("pattern").agg(F.max_by("folder", F.struct("updated_at", "seq")).alias("folder"))


def folder_usage(moves: DataFrame) -> DataFrame:
    """Times each folder was used, and its first move."""
    return moves.groupBy("folder").agg(F.count(F.lit(1)).alias("used_count"), F.min("move_id").alias("first_seen"))


def usage_order() -> list[Column]:
    return [F.col("used_count").desc(), F.col("first_seen").asc()]


def with_learned(df: DataFrame, rules: DataFrame, signature: Column, name: str) -> DataFrame:
    """Adds the folder learned for a signature, or null."""
    r = rules.select(F.col("pattern").alias("_sig"), F.col("folder").alias(name))
    return df.withColumn("_sig", signature).join(r, "_sig", "left").drop("_sig")


def known_signatures() -> list[str]:
    """All signatures under which a folder can be learned for the cascade."""
    hints = {category for _, category in K.FILENAME_PATTERNS} | {"Photos", "Screenshots"}
    return [f"keyword:{c}" for c in K.KEYWORD_PATTERNS] + ["chart_trading"] + [f"heur:{c}" for c in sorted(hints)]


def all_folder_names(*sources: DataFrame) -> DataFrame:
    """Names of used, learned and existing folders together."""
    out = sources[0].select("folder")
    for s in sources[1:]:
        out = out.unionByName(s.select("folder"))
    return out.distinct()


# --- the cascade --------------------------------------------------------------------------------
def cascade(df: DataFrame) -> DataFrame:
    """One suggestion per asset. Expects per asset: kind, fuzzy_folder, fuzzy_conf, sem_folder, sem_conf,
    sem_reason, keyword_category, is_chart, hint, and the folders learned for the three signatures
    (rule_keyword, rule_chart, rule_hint)."""
    image = F.col("kind") == "image"
    sem = F.col("sem_folder").isNotNull()
    fuzzy = F.col("fuzzy_folder").isNotNull()
    strong_name = fuzzy & (F.col("fuzzy_conf") >= 0.85) & (~sem | (F.col("sem_conf") < 0.93))
    keyword = F.col("keyword_category").isNotNull()
    chart = image & F.coalesce("is_chart", F.lit(False))
    hint = image & F.col("hint").isNotNull()
    doc = is_document("kind")
    cat, h = F.col("keyword_category"), F.col("hint")
    by_kind = F.when(F.col("kind") == "xlsx", "Spreadsheets").otherwise("Other")

    def pick(category, folder, confidence, reason) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(as_col(category).alias("category"), as_col(folder).alias("suggested_folder"),
                        as_col(confidence).cast("double").alias("confidence"), as_col(reason).alias("reason"))

    def known(folder: str, conf: str, reason) -> Column:
        return pick(category_of_folder(folder), F.col(folder), F.col(conf), reason)

    s = (
        F.when(strong_name, known("fuzzy_folder", "fuzzy_conf", "match_known_folder"))
        .when(sem, known("sem_folder", "sem_conf", F.col("sem_reason")))
        .when(fuzzy, known("fuzzy_folder", "fuzzy_conf", "match_known_folder"))
        .when(keyword & F.col("rule_keyword").isNotNull(), pick(cat, F.col("rule_keyword"), 0.85, "learned_rule"))
        .when(keyword, pick(cat, cat, F.when(image, 0.65).otherwise(0.75), F.concat(F.lit("keyword:"), cat)))
        .when(chart & F.col("rule_chart").isNotNull(), pick("Forex", F.col("rule_chart"), 0.95, "learned_rule"))
        .when(chart, pick("Forex", "Forex/Charts", 0.85, "chart_heuristic"))
        .when(hint & F.col("rule_hint").isNotNull(),
              pick(h["category"], F.col("rule_hint"), h["confidence"] + 0.10, "learned_rule"))
        .when(hint, pick(h["category"], h["folder"], h["confidence"], F.concat(F.lit("heuristic:"), h["category"])))
        .when(doc, pick(by_kind, by_kind, 0.25, F.concat(F.lit("type:"), F.col("kind"))))
        .otherwise(pick("Other", "Other", 0.0, "fallback"))
    )
    return df.select("asset_id", "path", "kind", s.alias("s")).select("asset_id", "path", "kind", "s.*")


def category_overview(suggestions: DataFrame) -> DataFrame:
    return suggestions.groupBy("category").agg(F.count(F.lit(1)).alias("n_files"))


def run_stats(suggestions: DataFrame, selected: Column) -> DataFrame:
    """Files, distinct categories, selected files. Categories are few, so they are counted first."""
    per = suggestions.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(selected).alias("sel"))
    return per.agg(F.sum("n").alias("n_files"), F.count(F.lit(1)).alias("n_categories"), F.sum("sel").alias("n_selected"))
