"""Annual and quarterly statements from filed facts and from statement lines."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bourseflow import constants as K
from bourseflow.accounts import (BALANCE_ACCOUNTS, CONCEPTS, CORE_ACCOUNTS, DIVIDEND_CONCEPTS, FLOW_ACCOUNTS, LINE_ACCOUNTS, MONEY_ACCOUNTS, NAME_PREFIX,
                                 STATEMENT_LINES)
from bourseflow.functions.exprs import half_up
from bourseflow.sources.market_tables import literal_rows


def concept_map(df: DataFrame) -> DataFrame:
    rows = [(c, a, i, d) for a, (cs, d) in CONCEPTS.items() for i, c in enumerate(cs)]
    return literal_rows(df.sparkSession, ("concept", "account", "priority", "duration"), rows)


def latest_filed(facts: DataFrame, forms: tuple[str, ...]) -> DataFrame:
    """One value per company, concept and period: the latest filing wins, the first filing date is kept."""
    return (facts.where(F.col("form").isin(*forms) & F.col("value").isNotNull())
            .groupBy("company", "concept", "start", "end").agg(F.max_by("value", "filed").alias("value"), F.min("filed").alias("first_filed")))


def by_account(facts: DataFrame, forms: tuple[str, ...]) -> DataFrame:
    """Facts as accounts: for each period the concept of highest priority. A filed equity of zero is ignored."""
    f = latest_filed(facts, forms).join(F.broadcast(concept_map(facts)), "concept")
    f = f.where((F.col("duration") == F.col("start").isNotNull()) & ~((F.col("account") == "total_equity") & (F.col("value") == 0)))
    w = F.struct("priority", "concept", "value")
    return (f.groupBy("company", "account", "duration", "start", "end")
            .agg(F.min(w).alias("b"), F.min("first_filed").alias("first_filed"))
            .select("company", "account", "duration", "start", "end", "b.value", "b.priority", "first_filed"))


def days(a: str = "start", b: str = "end") -> Column:
    return F.datediff(b, a)


def derive(wide: DataFrame) -> DataFrame:
    """Fill what can be computed: operating income from pre-tax income, liabilities from the total, debt and intangibles from parts."""
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0))
    long_parts = F.when(c("ltd_noncurrent").isNotNull() | c("ltd_current").isNotNull(), zero(c("ltd_noncurrent")) + zero(c("ltd_current")))
    long = F.coalesce(c("ltd_total"), long_parts)
    note = F.array_join(F.array_compact(F.array(
        F.when(c("operating_income").isNull() & c("pretax").isNotNull(), F.lit("operating_income")),
        F.when(c("total_debt").isNull() & c("liabilities_and_equity").isNotNull()
               & F.coalesce("equity_with_nci", "total_equity").isNotNull(), F.lit("total_debt")))), ",")
    return wide.withColumns({
        "derived": note,
        "operating_income": F.coalesce(c("operating_income"), c("pretax") + zero(c("interest_expense"))),
        "total_debt": F.coalesce(c("total_debt"), c("liabilities_and_equity") - F.coalesce("equity_with_nci", "total_equity")),
        "intangibles": F.coalesce(c("intangibles_total"), F.when(c("intangibles_other").isNotNull() | c("goodwill").isNotNull(),
                                                                 zero(c("intangibles_other")) + zero(c("goodwill")))),
        "borrowings": F.when(long.isNotNull() | c("short_debt").isNotNull(), zero(long) + zero(c("short_debt")))})


def annual_from_facts(facts: DataFrame, years: int) -> DataFrame:
    """Annual statements of the newest N fiscal years. A fiscal year end is a date with annual revenue or net income."""
    a = by_account(facts, K.ANNUAL_FORMS).where(~F.col("duration") | days().between(350, 380))
    a = (a.groupBy("company", "account", "end").agg(F.min(F.struct("start", "value", "priority")).alias("x"), F.min("first_filed").alias("ff"))
         .select("company", "account", F.col("end").alias("period_end"), "x.value", "x.priority", "ff"))
    main = F.col("account").isin("revenue", "net_income")
    wide = a.groupBy("company", "period_end").agg(
        *[F.max(F.when(F.col("account") == n, F.col("value"))).alias(n) for n in CONCEPTS],
        F.max(main).alias("is_year"), F.min(F.when(main, F.col("ff"))).alias("filed_at"),
        F.array_join(F.array_sort(F.collect_list(F.when((F.col("priority") > 0) & F.col("account").isin(*CORE_ACCOUNTS), F.col("account")))), ",").alias("substitutes"))
    newest = Window.partitionBy("company").orderBy(F.desc("period_end"))
    wide = wide.where("is_year").withColumn("k", F.row_number().over(newest)).where(F.col("k") <= years)
    return derive(wide).select("company", "period_end", *MONEY_ACCOUNTS, "filed_at", "substitutes", "derived")


def quarters_from_facts(facts: DataFrame, accounts: tuple[str, ...] = FLOW_ACCOUNTS) -> DataFrame:
    """Three-month amounts: filed as such, else the difference of year-to-date amounts; Q4 = year minus nine months. Balances stand as
    filed for the quarter's last day.

    A fiscal year has four quarters, so they are laid out side by side and the chain is written as plain expressions."""
    every = by_account(facts, K.QUARTER_FORMS)
    a = every.where("duration").where(F.col("account").isin(*accounts, "revenue", "net_income"))
    year_ends = (a.where(days().between(350, 380) & F.col("account").isin("revenue", "net_income")).select("company", F.col("end").alias("fy_end")).distinct())
    prev = F.lag("fy_end").over(Window.partitionBy("company").orderBy("fy_end"))
    gap = F.datediff("fy_end", "prev")
    spans = year_ends.withColumn("prev", prev).select(
        "company", "fy_end", F.when(gap.between(350, 380), F.date_add("prev", 1)).otherwise(F.date_sub("fy_end", 364)).alias("fy_start"))
    j = a.join(spans, "company").where((F.col("end") > F.col("fy_start")) & (F.col("end") <= F.col("fy_end")))
    d = days()
    kind = (F.when(d.between(350, 380), "year").when(d.between(85, 100), "three").when((d >= 150) & (d < 350), "ytd"))
    near_start = F.abs(F.datediff("start", "fy_start")) <= 7
    k = F.when(F.col("end") == F.col("fy_end"), 4).otherwise(
        F.least(F.lit(3), F.greatest(F.lit(1), F.round(F.datediff("end", "fy_start") / F.lit(91.3)).cast("int"))))
    early = F.col("end") < F.date_sub("fy_end", 20)
    j = (j.withColumn("kind", kind).withColumn("k", k).where("kind IS NOT NULL")
         .where((F.col("kind") != "ytd") | near_start).where((F.col("k") == 4) | early))
    cell = lambda kd, q: F.max(F.when((F.col("kind") == kd) & (F.col("k") == q), F.col("value")))
    q = j.groupBy("company", "fy_start", "fy_end", "account").agg(
        *[cell("three", i).alias(f"q{i}") for i in (1, 2, 3, 4)], *[cell("ytd", i).alias(f"y{i}") for i in (2, 3)], cell("year", 4).alias("y4"),
        *[F.max(F.when(F.col("k") == i, F.col("end"))).alias(f"e{i}") for i in (1, 2, 3)])
    have = q.where(F.col("account").isin("revenue", "net_income")).groupBy("company", "fy_end").agg(*[F.max(f"e{i}").alias(f"h{i}") for i in (1, 2, 3)])
    q = q.join(have, ["company", "fy_end"])
    c = F.col
    cum1 = c("q1")
    p2 = F.when(c("h1").isNotNull(), cum1)
    cum2 = F.coalesce(c("y2"), p2 + c("q2"))
    p3 = F.when(c("h2").isNotNull(), cum2)
    cum3 = F.coalesce(c("y3"), p3 + c("q3"))
    p4 = F.when(c("h3").isNotNull(), cum3)
    row = lambda k, end, value: F.struct(F.lit(k).alias("k"), c(end).alias("period_end"), value.alias("value"))
    rows = F.array(row(1, "h1", c("q1")), row(2, "h2", F.coalesce(c("q2"), c("y2") - p2)),
                   row(3, "h3", F.coalesce(c("q3"), c("y3") - p3)), row(4, "fy_end", F.coalesce(c("y4") - p4, c("q4"))))
    out = q.where(c("account").isin(*accounts)).select("company", "account", F.inline(rows)).where("period_end IS NOT NULL")
    wide = out.groupBy("company", "period_end", "k").agg(*[half_up(F.max(F.when(c("account") == n, c("value"))), 2).alias(n) for n in accounts])
    held = every.where(~F.col("duration") & F.col("account").isin(*BALANCE_ACCOUNTS)).groupBy("company", F.col("end").alias("period_end")).agg(
        *[half_up(F.max(F.when(c("account") == n, c("value"))), 2).alias(n) for n in BALANCE_ACCOUNTS])
    return wide.where(" OR ".join(f"{n} IS NOT NULL" for n in accounts)).join(held, ["company", "period_end"], "left")


def dividends(facts: DataFrame, today: str) -> DataFrame:
    """Annual dividend per share: the newest annual amount, else four adjoining quarters that cover a year and are recent."""
    rank = F.create_map(*[x for i, n in enumerate(DIVIDEND_CONCEPTS) for x in (F.lit(n), F.lit(i))])[F.col("concept")]
    d = facts.where(F.col("concept").isin(*DIVIDEND_CONCEPTS)).withColumn("pr", rank)
    year = (d.where(F.col("form").isin(*K.ANNUAL_FORMS) & days().between(350, 380))
            .groupBy("company", "pr").agg(F.max_by(F.struct("value", "end"), F.struct("end", "filed")).alias("x")))
    year = year.groupBy("company").agg(F.min_by("x", "pr").alias("x")).select("company", F.col("x.value").alias("y_dps"), F.col("x.end").alias("y_end"))
    qs = (d.where(days().between(85, 100)).groupBy("company", "pr", "start", "end").agg(F.max_by("value", "filed").alias("value")))
    # newest quarters first; a quarter that overlaps the one picked before it is skipped. The quarter-long periods of one
    # company are bounded by the calendar, so the fold runs over a short array
    every = qs.groupBy("company", "pr").agg(F.sort_array(F.collect_list(F.struct("end", "start", "value")), asc=False).alias("qs"))
    pick = F.aggregate("qs", F.slice("qs", 1, 1), lambda acc, x: F.when(
        (F.size(acc) < 4) & (x["end"] < F.element_at(acc, -1)["start"]), F.concat(acc, F.array(x))).otherwise(acc))
    four = every.withColumn("p", pick).where(F.size("p") == 4)
    cover = F.datediff(F.col("p")[0]["end"], F.col("p")[3]["start"])
    fresh = F.datediff(F.lit(today).cast("date"), F.col("p")[0]["end"]) <= 400
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["value"].cast("double"))
    four = (four.where(cover.between(350, 380) & fresh).groupBy("company")
            .agg(F.min_by(F.struct(total.alias("v"), F.col("p")[0]["end"].alias("e")), "pr").alias("x")))
    j = year.join(four, "company", "full")
    return j.select("company", half_up(F.coalesce(F.col("y_dps").cast("double"), F.col("x.v")), 4).alias("dps"), F.coalesce("y_end", "x.e").alias("period_end"))


def newest_shares(shares: DataFrame) -> DataFrame:
    """Shares of the newest cover date: classes of one filing are added, the largest filing wins."""
    per = shares.groupBy("company", "end", "accn").agg(F.sum("value").alias("v")).groupBy("company", "end").agg(F.max("v").alias("v"))
    return per.groupBy("company").agg(F.max_by("v", "end").alias("shares"), F.max("end").alias("as_of"))


def accounts_from_lines(lines: DataFrame) -> DataFrame:
    """Statement lines to accounts: consolidated lines where a company has them; account id first, then the cleaned name."""
    rows = []
    for a, (sts, ids, names) in STATEMENT_LINES.items():
        rows += [(a, s, "id", x, i) for s in sts for i, x in enumerate(ids)]
        rows += [(a, s, "name", x, 100 + i) for s in sts for i, x in enumerate(names)]
    m = F.broadcast(literal_rows(lines.sparkSession, ("account", "statement", "by", "label", "priority"), rows))
    keys = ["company", "period_end"]
    cons = lines.groupBy(*keys).agg(F.bool_or("consolidated").alias("has_cons"))
    x = lines.join(cons, keys).where(F.col("consolidated") == F.col("has_cons")).where("amount IS NOT NULL")
    x = x.withColumn("name", F.regexp_replace(F.regexp_replace("account_nm", NAME_PREFIX, ""), r"\s+", ""))
    labels = F.array(F.struct(F.lit("id").alias("by"), F.col("account_id").alias("label")), F.struct(F.lit("name").alias("by"), F.col("name").alias("label")))
    x = x.withColumn("l", F.explode(labels)).select(*keys, "consolidated", "statement", "line_no", "amount", "prior_amount", "l.by", "l.label")
    st = F.create_map(F.lit("BS"), F.lit(0), F.lit("IS"), F.lit(1), F.lit("CIS"), F.lit(2), F.lit("CF"), F.lit(3))[F.col("statement")]
    hit = x.join(m, ["statement", "by", "label"]).groupBy(*keys, "account").agg(
        F.min(F.struct("priority", st.alias("st"), "line_no", "amount", "prior_amount", "consolidated")).alias("h"))
    return hit.select(*keys, "account", F.col("h.amount").alias("amount"), F.col("h.prior_amount").alias("prior_amount"), F.col("h.consolidated").alias("consolidated"))


def annual_from_lines(lines: DataFrame) -> DataFrame:
    """Annual statements with blanks filled from the prior-year column of next year's report of the same kind."""
    acc = accounts_from_lines(lines)
    cell = lambda n, v: F.max(F.when(F.col("account") == n, F.col(v)))
    wide = acc.groupBy("company", "period_end").agg(F.bool_or("consolidated").alias("consolidated"), *[cell(n, "amount").alias(n) for n in LINE_ACCOUNTS],
                                                    *[cell(n, "prior_amount").alias(f"p_{n}") for n in LINE_ACCOUNTS])
    w = Window.partitionBy("company").orderBy("period_end")
    same = (F.lead("period_end").over(w) == F.add_months("period_end", 12)) & (F.lead("consolidated").over(w) == F.col("consolidated"))
    nxt = {n: F.when(same, F.lead(f"p_{n}").over(w)) for n in LINE_ACCOUNTS}
    filled = F.array_join(F.array_compact(F.array(*[F.when(F.col(n).isNull() & nxt[n].isNotNull(), F.lit(n)) for n in LINE_ACCOUNTS])), ",")
    own = wide.select("company", "period_end", "consolidated", *[F.coalesce(F.col(n), nxt[n]).alias(n) for n in LINE_ACCOUNTS], filled.alias("filled"))
    # a year without any report of its own is taken from next year's prior column
    years = wide.select("company", F.col("period_end").alias("have"))
    before = wide.select("company", F.add_months("period_end", -12).alias("period_end"), "consolidated", *[F.col(f"p_{n}").alias(n) for n in LINE_ACCOUNTS],
                         F.lit("all").alias("filled"))
    first = wide.groupBy("company").agg(F.min("period_end").alias("first"))
    whole = (before.join(years, (before.company == years.company) & (before.period_end == years.have), "left_anti")
             .join(first, "company").where("period_end > first").drop("first").where(" OR ".join(f"{n} IS NOT NULL" for n in LINE_ACCOUNTS)))
    return own.unionByName(whole)
