"""Questions resolved to one value over the cells of records, and answers read off the first chunk that holds them; for batches of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions import scalars
from strataframe.operators.aggregates import EXACT
from strataframe.sources.staging import stored

# Columns that describe a key-value row, patterns of its label by metric (and of what it must not hold), and the names shown.
LABELS = ("Field", "Metric", "Parameter", "Indicator", "Item", "Key")
VALUES = ("Value", "Value_original", "value")
LABELLED = {
    "production_target": (r"\btarget\b", None, "Production target"), "production": (r"\bproduction\b", r"\btarget\b", "Production"), "dispatch": (r"\bdispatch\b|\bofftake\b", None, "Dispatch"), "achievement": (r"\bachievement\b", None, "Achievement"),
    **{m: (rf"\b{m.replace('_', ' ')}\b", None, None) for m in ("sales", "pbt", "pat", "eps", "dividend", "capex", "net_worth", "overburden", "grade", "reserve", "borehole")},
}
# Columns that hold a metric in a table, the first there is, with the name shown; any other metric has a column of its name.
COLUMNS = {"production_target": (("target", "production_target"), "Production target"), "production": (("production",), "Production"), "dispatch": (("dispatch", "offtake"), "Dispatch")}
SUBSIDIARY, MINE = ("subsidiary", "company", "company_name"), ("mine", "mine_name", "Mine Name")
# Units by what a value says, and the one where it says nothing.
SAID = (("tonne", "Tonnes"), ("crore", "Crore"), ("%", "%"), ("bcm", "Million BCM"))
UNIT = "MT"
# Why nothing was found.
NO_METRIC, NO_SUBSIDIARY = "No structured metric identified in query.", "No record found for subsidiary "
NO_VALUE = "I could not find a sufficiently specific value for that field in the selected document."
NO_REFERENCE = "I could not find sufficient evidence in the authorized organization reference data."


def _get(key: str | Column) -> Column:
    return F.try_element_at("data", F.lit(key) if isinstance(key, str) else key)


def _first(keys: tuple[str, ...]) -> Column:
    """The first of the cells that holds anything."""
    return F.coalesce(*[F.nullif(_get(k), F.lit("")) for k in keys])


def year_keys(text: Column) -> Column:
    """Every year text that a cell holds, at whatever place: four digits from 20 on, and with a hyphen two to four more. What a question's year can be found in a text as is one of these."""
    found = F.regexp_extract_all(F.translate(F.lower(text), "–", "-"), F.lit(r"(?=(20\d{2}(?:-\d{2,4})?))"), 1)
    return F.array_distinct(F.flatten(F.transform(found, lambda m: F.filter(F.array(*[F.when(F.length(m) >= n, F.substring(m, 1, n)) for n in (4, 7, 8, 9)]), lambda x: x.isNotNull()))))


def candidates(records: DataFrame) -> DataFrame:
    """``records(scope, record_id, row_index, data map)`` to a row a record and metric that it has a value of: (scope, metric, years, item, is_document).

    A row with a label (``LABELS``) is a summary of its document: the label says the metric. Any other row is one of a table, with a subsidiary and a mine. ``item`` is a struct that is ordered as records are.
    """
    label = F.trim(_first(LABELS))
    low = F.lower(label)
    said = F.trim(F.coalesce(_first(VALUES), F.lit("")))
    clean = F.trim(F.regexp_replace(said, r"^[n=\s]+", ""))
    unit = F.coalesce(*[F.when(F.lower(clean).contains(word), F.lit(u)) for word, u in SAID], F.lit(UNIT))
    none = F.lit(None).cast("string")

    def item(display: Column, formatted: Column, number: Column, unit: Column, subsidiary: Column, mine: Column) -> Column:
        return F.struct(F.col("row_index").cast("long").alias("row_index"), "record_id", display.alias("display"), formatted.alias("formatted"), number.alias("number"), unit.alias("unit"), subsidiary.alias("subsidiary"), mine.alias("mine"))

    kv = []
    for metric, (has, hasnt, shown) in LABELLED.items():
        test = low.rlike(has) & (~low.rlike(hasnt) if hasnt else F.lit(True))
        kv.append(F.when(test, F.struct(F.lit(metric).alias("metric"), item(F.lit(shown) if shown else label, clean, scalars.leading_number(clean), unit, none, F.trim(_first(MINE))).alias("item"))))
    tabular = []
    # a column counts in whatever case its name is written
    subsidiary = F.trim(F.get(F.filter(F.transform(F.map_entries("data"), lambda e: F.when(F.lower(e["key"]).isin(*SUBSIDIARY), F.nullif(e["value"], F.lit("")))), lambda x: x.isNotNull()), 0))
    for metric in LABELLED:
        names, shown = COLUMNS.get(metric, ((metric,), metric.replace("_", " ").capitalize()))
        name = F.coalesce(*[F.when(F.map_contains_key("data", n), F.lit(n)) for n in names])
        formatted = F.trim(F.coalesce(F.nullif(_get(F.concat(name, F.lit("_original"))), F.lit("")), _get(name), F.lit("")))
        own = F.when(F.lower(formatted).contains("tonne"), "Tonnes").otherwise(F.coalesce(F.nullif(_get(F.concat(name, F.lit("_unit"))), F.lit("")), F.lit(UNIT)))
        tabular.append(F.when(name.isNotNull(), F.struct(F.lit(metric).alias("metric"), item(F.lit(shown), formatted, scalars.leading_number(_get(name)), own, subsidiary, F.trim(_first(MINE))).alias("item"))))
    is_document = label.isNotNull()
    rows = records.select("scope", year_keys(F.array_join(F.map_values("data"), " ")).alias("years"), is_document.alias("is_document"), F.when(is_document, F.array(*kv)).otherwise(F.array(*tabular)).alias("all_"))
    return rows.select("scope", "years", "is_document", F.inline(F.filter("all_", lambda x: x.isNotNull())))


def _mine_names(mine: Column) -> Column:
    """A mine's name, and the name without what stands in brackets, of three letters or more each."""
    low = F.lower(F.trim(mine))
    return F.filter(F.array_distinct(F.array(low, F.trim(F.regexp_replace(low, r"\(.*?\)", "")))), lambda n: F.length(n) >= 3)


def resolved(questions: DataFrame, records: DataFrame) -> DataFrame:
    """``questions(question_id, scope, text, subsidiary, year, metric, aggregation)`` to a row each: (question_id, found, calculation, metric_display, subsidiary, mine, value, formatted, unit, record_id, reason).

    A question whose text names a mine gets that mine's first row. One that names a subsidiary gets the subsidiary's first row. Any other one gets the first summary row; without one, of the
    table's rows the sum (also where the text says total, and where nothing is asked), the highest, the lowest or the average. Rows count whose cells hold the question's year, in any column; a null year is any.
    Ranks are by row and record. Without a metric, a row or a value nothing is found.

    Records are read once for all questions, and their candidates grouped by scope, metric, year, subsidiary and mine; what questions join to is made of these groups.
    """
    each = candidates(records)
    each = each.select("scope", "metric", "is_document", "item", F.explode(F.concat(F.array(F.lit(None).cast("string")), "years")).alias("y"))
    key = ["scope", "metric", "y"]
    number = F.col("item.number")
    of_row = lambda value, more=F.lit(True): F.when(~F.col("is_document") & more, value)
    valued = lambda by: F.min(of_row(F.struct(by.alias("v"), "item"), number.isNotNull()))
    groups = stored(each.groupBy(*key, F.upper("item.subsidiary").alias("s_"), F.col("item.mine").alias("mine_")).agg(
        F.min(F.when(F.col("is_document"), F.col("item"))).alias("document"), F.min(of_row(F.col("item"))).alias("first"), F.min(of_row(F.col("item"), number.isNotNull())).alias("counted"),
        F.sum(of_row(number.cast(EXACT))).alias("total"), F.count(of_row(number)).alias("n"), valued(number).alias("lowest"), valued(-number).alias("highest")), questions.sparkSession)
    whole = groups.groupBy(*key).agg(
        *[F.min(c).alias(c) for c in ("document", "first", "counted")], F.sum("total").cast("double").alias("total"), F.sum("n").alias("n"), *[F.min(c)["item"].alias(c) for c in ("lowest", "highest")])
    rows = groups.where("first is not null")
    by_subsidiary = rows.where("s_ is not null").groupBy(*key, "s_").agg(F.min("first").alias("of_subsidiary"))
    named = rows.select(*key, "first", F.explode(_mine_names(F.col("mine_"))).alias("m_")).groupBy(*key, "m_").agg(F.min("first").alias("of_mine"))
    q = questions.select("question_id", F.col("scope").alias("qs_"), F.col("subsidiary").alias("asked_"), F.lower(F.coalesce("text", F.lit(""))).alias("low"), F.upper("subsidiary").alias("sub_"), F.translate(F.regexp_replace(F.lower("year"), "fy| ", ""), "–", "-").alias("year_"), F.col("metric").alias("qm_"), F.col("aggregation").alias("agg_"))
    same = F.expr("qs_ <=> scope and qm_ = metric and year_ <=> y")
    # a mine's name may stand anywhere in the text: all parts of the text that are as long as some name
    lengths = [r[0] for r in named.select(F.length("m_")).distinct().collect()]  # numbers below the longest name's
    pieces = F.array_distinct(F.flatten(F.transform(F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length("low")), lambda n: F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), lambda i: F.substring(F.col("low"), i, n))))) if lengths else F.array().cast("array<string>")
    of_mine = q.select("question_id", "qs_", "qm_", "year_", F.explode(pieces).alias("piece")).join(named, same & F.expr("piece = m_")).groupBy("question_id").agg(F.min("of_mine").alias("of_mine"))
    out = q.join(of_mine, "question_id", "left").join(by_subsidiary, same & F.expr("sub_ = s_"), "left").drop(*key, "s_").join(whole, same, "left")
    kind = (
        F.when(F.col("of_mine").isNotNull(), "mine").when(F.col("sub_").isNotNull(), "subsidiary").when(F.col("document").isNotNull(), "document")
        .when((F.col("agg_") == "sum") | F.col("low").contains("total"), "sum").when(F.col("agg_").isin("max", "min", "avg"), F.col("agg_")).otherwise("sum")
    )
    out = out.withColumn("kind", kind)
    of = lambda **given: F.coalesce(*[F.when(F.col("kind") == k, c) for k, c in given.items()])
    some = F.col("n") > 0
    chosen = of(mine=F.col("of_mine"), subsidiary=F.col("of_subsidiary"), document=F.col("document"), sum=F.when(some, F.col("first")), max=F.col("highest"), min=F.col("lowest"), avg=F.col("counted"))
    out = out.withColumn("item", chosen)
    made = F.col("kind").isin("sum", "avg")
    value = F.when(F.col("kind") == "sum", F.col("total")).when(F.col("kind") == "avg", F.col("total") / F.col("n")).otherwise(F.col("item.number"))
    places = F.when((F.col("kind") == "sum") & (F.col("total") == F.floor("total")), F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    found = F.col("item").isNotNull()
    return out.select(
        "question_id", found.alias("found"), F.when(found, F.when(F.col("kind") == "mine", "lookup").when(F.col("kind").isin("subsidiary", "document"), F.coalesce("agg_", F.lit("lookup"))).otherwise(F.col("kind"))).alias("calculation"),
        F.when(found, F.when(F.col("kind") == "sum", F.concat(F.lit("Total "), "qm_")).when(F.col("kind") == "avg", F.concat(F.lit("Average "), "qm_")).otherwise(F.col("item.display"))).alias("metric_display"),
        F.when(~made, F.col("item.subsidiary")).alias("subsidiary"), F.col("item.mine").alias("mine"), F.when(found, value).alias("value"), F.when(found, F.when(made, F.concat(places, F.lit(" "), "item.unit")).otherwise(F.col("item.formatted"))).alias("formatted"),
        F.col("item.unit").alias("unit"), F.col("item.record_id").alias("record_id"),
        F.when(~found, F.when(F.col("qm_").isNull(), NO_METRIC).when(F.col("kind") == "subsidiary", F.concat(F.lit(NO_SUBSIDIARY), "asked_")).otherwise(NO_VALUE)).alias("reason"))


def _either(questions: DataFrame, records: DataFrame) -> DataFrame:
    """``resolved``, and for questions whose year finds nothing the same without the year; ``year`` is the one that found it."""
    q = questions.withColumn("question_id", F.struct("question_id", F.lit(0).alias("again")))
    more = questions.where("year is not null").withColumn("question_id", F.struct("question_id", F.lit(1).alias("again"))).withColumn("year", F.lit(None).cast("string"))
    both = q.unionByName(more)
    found = resolved(both, records).join(both.select("question_id", "year"), "question_id")
    best = F.min_by(F.struct(*[c for c in found.columns if c != "question_id"]), F.struct((~F.col("found")).alias("missed"), "question_id.again"))
    last = F.max_by("reason", "question_id.again")  # of the attempts
    return found.groupBy("question_id.question_id").agg(best.alias("r"), last.alias("why")).select("question_id", "r.*", "why").drop("reason").withColumnRenamed("why", "reason")


def _shown(value: Column) -> Column:
    """A number as it is written: one place at least, no exponent."""
    plain = F.when((F.abs(value) < 1e15) & (value == F.floor(value)), F.concat(F.floor(value).cast("string"), F.lit(".0")))
    return F.coalesce(plain, F.when((F.abs(value) >= 1e7) | (F.abs(value) < 1e-3), F.regexp_replace(F.format_string("%.6f", value), r"0+$", "")).when(value.isNotNull(), value.cast("string")))


def question_years(text: Column) -> Column:
    """Financial years that a text names, as ``YYYY-YY`` or longer, sorted."""
    low, pattern = F.lower(text), F.lit(r"\b(?:fy\s*)?(20\d{2})[-–/](\d{2,4})\b")
    return F.array_sort(F.zip_with(F.regexp_extract_all(low, pattern, 1), F.regexp_extract_all(low, pattern, 2), lambda a, b: F.concat(a, F.lit("-"), b)))


def compared_answers(questions: DataFrame, current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``questions`` as for ``resolved``, over a question's own ``current`` records and the ``baseline`` ones (scope null: everyone's), to (question_id, kind, current_value, baseline_value, difference, pct, answer, confidence).

    Of two years or more in a question's text the least is the baseline's and the greatest the current one; else both sides take ``year``. A side that finds nothing for its year is asked without it. With both values the
    answer is computed (``compared``); with one it says which is missing (``no_baseline``, ``no_current``); without any there is none (``none``), and chunks must answer.
    """
    years = question_years(F.coalesce("text", F.lit("")))
    q = questions.withColumn("ys_", years)
    of = lambda at: q.withColumn("year", F.when(F.size("ys_") >= 2, F.element_at("ys_", at)).otherwise(F.col("year"))).drop("ys_")
    now = _either(of(-1), current).select("question_id", *[F.col(c).alias(f"now_{c}") for c in ("found", "value", "unit", "subsidiary", "year", "reason")])
    then = _either(of(1).withColumn("scope", F.lit(None).cast("string")), baseline).select("question_id", *[F.col(c).alias(f"then_{c}") for c in ("found", "value", "unit", "year", "reason")])
    out = questions.select("question_id", "metric", F.col("subsidiary").alias("asked")).join(now, "question_id").join(then, "question_id")
    both = F.col("now_value").isNotNull() & F.col("then_value").isNotNull()
    kind = F.when(both, "compared").when(F.col("now_found") & ~F.col("then_found"), "no_baseline").when(F.col("then_found") & ~F.col("now_found"), "no_current").otherwise("none")
    out = out.withColumn("kind", kind).withColumn("difference", F.when(both, F.round(F.col("now_value") - F.col("then_value"), 2)))
    out = out.withColumn("pct", F.when(F.col("then_value") != 0, F.round(F.col("difference") / F.col("then_value") * 100, 2)))
    who = F.coalesce(F.concat(F.coalesce(F.nullif("now_subsidiary", F.lit("")), F.nullif("asked", F.lit(""))), F.lit(" ")), F.lit(""))
    unit, amount = F.coalesce("now_unit", F.lit(UNIT)), scalars.fixed(F.abs("difference"), 2)
    text = F.concat(who, F.initcap(F.substring(F.col("metric"), 1, 1)), F.lower(F.substring(F.col("metric"), F.lit(2), F.length("metric"))), F.lit(" was "), _shown(F.col("now_value")), F.lit(" "), unit, F.lit(" in "), F.coalesce("now_year", F.lit("current period")),
                    F.lit(", compared with "), _shown(F.col("then_value")), F.lit(" "), unit, F.lit(" in "), F.coalesce("then_year", F.lit("baseline period")), F.lit(". The "), F.when(F.col("difference") >= 0, "increase").otherwise("decrease"), F.lit(" was "), amount, F.lit(" "), unit,
                    F.when(F.col("pct").isNotNull(), F.concat(F.lit(" ("), scalars.fixed(F.abs("pct"), 1), F.lit("%)"))).otherwise(""), F.lit("."))
    missing = lambda side, value, unit, why, tail: F.concat(F.lit(f"{side} value: "), F.coalesce(_shown(F.col(value)), F.lit("None")), F.lit(" "), F.coalesce(unit, F.lit(UNIT)), F.lit(f". {tail}"), F.lit(" ("), why, F.lit(")."))
    answer = (
        F.when(F.col("kind") == "compared", text)
        .when(F.col("kind") == "no_baseline", missing("Current", "now_value", "now_unit", "then_reason", "I could not calculate this comparison because a valid historical baseline value was not available in the authorized baseline data"))
        .when(F.col("kind") == "no_current", missing("Baseline", "then_value", "then_unit", "now_reason", "I could not calculate this comparison because a current document value was not available"))
    )
    return out.select("question_id", "kind", F.col("now_value").alias("current_value"), F.col("then_value").alias("baseline_value"), "difference", "pct", answer.alias("answer"), F.when(F.col("kind") == "compared", "HIGH").when(F.col("kind") != "none", "LOW").alias("confidence"))


def organization_answers(questions: DataFrame, records: DataFrame, titles: DataFrame, found: DataFrame) -> DataFrame:
    """``questions`` over the reference ``records`` of everyone, then over their chunks: (question_id, query_type, answer, confidence, evidence).

    A value among the records answers with its document (``titles(record_id, document_title)``), with high confidence. Else the first of ``found(question_id, rank, score, content, document_title)``, the chunks that a search of
    the reference documents gave, is quoted, with the confidence that its score has. Without chunks nothing is found.
    """
    every = questions.withColumn("scope", F.lit(None).cast("string"))
    value = resolved(every, records).where("found").join(titles, "record_id", "left")
    top = found.groupBy("question_id").agg(F.min(F.struct("rank", "score", "content", "document_title")).alias("top"), F.count("*").alias("chunks"))
    out = questions.select("question_id").join(value, "question_id", "left").join(top, "question_id", "left")
    held = F.coalesce("found", F.lit(False))
    said = F.concat(F.lit("According to the authorized organization historical report ("), F.coalesce("document_title", F.lit("authorized organization records")), F.lit("), "), "metric_display", F.lit(" was "), F.coalesce(F.nullif("formatted", F.lit("")), _shown(F.col("value"))), F.lit(" "), "unit", F.lit("."))
    quoted = F.concat(F.lit("According to authorized organization reference records in "), F.col("top.document_title"), F.lit(": "), F.substring("top.content", 1, 200), F.lit("."))
    answer = F.when(held, said).when(F.col("top").isNotNull(), quoted).otherwise(NO_REFERENCE)
    sure = F.when(held, "HIGH").when(F.col("top.score") >= 1.0, "HIGH").when(F.col("top.score") >= 0.4, "MEDIUM").otherwise("LOW")
    return out.select("question_id", F.when(held, "STRUCTURED").otherwise("DOCUMENT").alias("query_type"), answer.alias("answer"), sure.alias("confidence"), F.when(held, 1).otherwise(F.coalesce("chunks", F.lit(0))).cast("long").alias("evidence"))


# answers from chunks

# Words of a question, and the keys in a text that answer it; texts of the answers.
ANSWERED_BY = [
    (("mine name", "name of mine"), ("mine name", "name")), (("location", "where", "located", "place"), ("location", "place", "district", "state", "address")),
    (("production target", "target production", "target"), ("production target", "target")), (("production", "output", "produced"), ("production", "output", "coal production", "quantity")),
    (("coal grade", "grade", "gcv", "calorific"), ("grade", "coal grade", "gcv", "calorific value")), (("year", "financial year", "fy", "period"), ("year", "financial year", "fy", "period", "date")),
    (("dispatch", "offtake", "supply"), ("dispatch", "offtake", "supply")), (("achievement",), ("achievement",)), (("sales", "revenue"), ("sales", "revenue")), (("pbt",), ("pbt",)), (("pat",), ("pat",)), (("eps",), ("eps",)),
    (("dividend",), ("dividend",)), (("capex",), ("capex",)), (("net worth", "networth"), ("net worth", "networth")), (("overburden", "ob removal"), ("overburden", "ob")), (("reserve", "resources"), ("reserve", "resources", "geological")),
    (("owner", "operator", "company"), ("owner", "operator", "company", "subsidiary")), (("capacity", "rated capacity"), ("capacity", "rated capacity")),
]
NO_EVIDENCE = "I could not find sufficient evidence in the available project data."
NOT_THERE = "I could not find that information in the selected document."
KEY_VALUE = r"^([^:\-=\n]{1,40})\s*[:\-=]\s*(.+)$"


def _strip(c: Column) -> Column:
    """Without white space around it, line ends too."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def target_keys(text: Column) -> Column:
    """Keys that answer a question, by the words it holds."""
    low = F.lower(text)
    asks = lambda words: low.rlike("|".join(words))
    return F.array_distinct(F.flatten(F.array(*[F.when(asks(words), F.array(*map(F.lit, keys))).otherwise(F.array().cast("array<string>")) for words, keys in ANSWERED_BY])))


def answers_from_chunks(questions: DataFrame, found: DataFrame) -> DataFrame:
    """``questions(question_id, text)`` and ``found(question_id, rank, content, document_title, page_number)`` to (question_id, kind, answer), a row a question.

    The lines of a question's chunks are read in rank order for keys that answer it, and the first chunk that has any gives all its lines (``fields``). Otherwise the sentence of the first chunk that holds most of the
    question's words answers (``sentence``), unless the question asks for keys and that chunk names none (``absent``). Without chunks there is no evidence (``none``).
    """
    q = questions.select("question_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"), target_keys(F.coalesce("text", F.lit(""))).alias("keys"))
    chunks = q.join(found, "question_id").withColumn("content", _strip(F.coalesce("content", F.lit(""))))
    holds = lambda text: F.exists("keys", lambda k: F.contains(text, k))
    lines = F.transform(F.split("content", r"[\r\n]+"), _strip)
    key = lambda x: _strip(F.regexp_extract(x, KEY_VALUE, 1))
    pairs = F.transform(F.filter(lines, lambda x: x.rlike(KEY_VALUE) & holds(F.lower(key(x)))), lambda x: F.concat(scalars.title_case(key(x)), F.lit(": "), _strip(F.regexp_extract(x, KEY_VALUE, 2))))
    read = chunks.withColumn("pairs", pairs)
    tokens = F.array_distinct(F.regexp_extract_all("low", F.lit(r"([a-zA-Z0-9]+)"), 1))
    sentences = F.filter(F.transform(F.split("content", r"(?<=[.!?])\s+|\n+"), _strip), lambda x: x != "")
    # the first of those with most hits: the greatest by (hits, minus place)
    scored = F.transform(sentences, lambda x, i: F.struct(F.size(F.filter("tokens", lambda t: F.contains(F.lower(x), t))).alias("hits"), (-i).alias("place"), x.alias("text")))
    top = F.struct("rank", "content", "document_title", "page_number", F.array_max(scored)["text"].alias("best"), holds(F.lower(F.col("content"))).alias("named"))
    best = read.withColumn("tokens", tokens).groupBy("question_id").agg(F.min(F.when(F.size("pairs") > 0, F.struct("rank", "pairs"))).alias("hit"), F.min(top).alias("top"))
    out = q.join(best, "question_id", "left")
    title = lambda other: F.coalesce("top.document_title", F.lit(other))
    kind = F.when(F.col("hit").isNotNull(), "fields").when(F.col("top").isNull() | (F.col("top.content") == ""), "none").when((F.size("keys") > 0) & ~F.col("top.named"), "absent").otherwise("sentence")
    page = F.when(F.coalesce("top.page_number", F.lit(0)) != 0, F.concat(F.lit(" (Page "), F.col("top.page_number").cast("string"), F.lit(")"))).otherwise("")
    answer = (
        F.when(F.col("kind") == "fields", F.concat(F.lit("According to "), title("the selected document"), F.lit(": "), F.array_join("hit.pairs", "; "), F.lit(".")))
        .when(F.col("kind") == "none", NO_EVIDENCE).when(F.col("kind") == "absent", NOT_THERE)
        .otherwise(F.concat(F.lit("According to verified project records in "), title("project documents"), page, F.lit(": "), "top.best", F.lit(".")))
    )
    return out.withColumn("kind", kind).select("question_id", "kind", answer.alias("answer"))
