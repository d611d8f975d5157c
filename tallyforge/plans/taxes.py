"""Tax summary, deductible expenses and the tax report dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.dates import in_year

# Ledger categories that count as deductible, and the class each belongs to.
DEDUCTION_CLASSES = {
    "Business": "business",
    "Office Supplies": "business",
    "Healthcare": "medical",
    "Charity": "charitable",
    "Education": "education",
    "Vehicle Maintenance": "vehicle",
}
# Form lines the totals go to.
FORM_LINES = {
    "wages": "Form 1040 line 1",
    "interest_income": "Form 1040 line 2b",
    "qualified_dividends": "Form 1040 line 3a",
    "ordinary_dividends": "Form 1040 line 3b",
    "capital_gains": "Form 1040 line 7",
    "medical": "Schedule A line 4",
    "charitable": "Schedule A line 11",
    "business": "Schedule C part II",
}
INCOME = ("wages", "interest_income", "ordinary_dividends", "qualified_dividends", "capital_gains")
MEASURES = (*INCOME, "federal_tax_withheld")


def tax_summary(documents: DataFrame) -> DataFrame:
    """Income and withholding per year and form kind, with a total per year (kind NULL)."""
    gains = F.coalesce("total_capital_gain", "gain_loss")
    rows = documents.withColumn("capital_gains", gains)
    total = F.lit(0).cast("decimal(28,2)")
    sums = [F.coalesce(F.sum(c), total).alias(c) for c in MEASURES]
    per_kind = rows.groupBy("tax_year", "document_type").agg(F.count("*").alias("documents"), *sums)
    per_year = per_kind.groupBy("tax_year").agg(
        F.sum("documents").alias("documents"), *[F.sum(c).alias(c) for c in MEASURES]
    )
    return per_kind.unionByName(per_year, allowMissingColumns=True)


def _class_of(category: Column, classes: dict[str, str]) -> Column:
    pairs = [F.lit(item) for pair in classes.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), category)


def deductible(transactions: DataFrame, year: int, classes: dict[str, str] | None = None) -> DataFrame:
    """Spending rows of the year that count as deductible, with their class."""
    known = classes or DEDUCTION_CLASSES
    rows = transactions.filter(
        in_year(F.col("transaction_date"), year) & (F.col("amount") < 0) & F.col("category").isin(*known)
    )
    return rows.withColumn("deduction_class", _class_of(F.col("category"), known))


def deduction_totals(transactions: DataFrame, year: int, classes: dict[str, str] | None = None) -> DataFrame:
    return (
        deductible(transactions, year, classes)
        .groupBy("deduction_class", "category")
        .agg(F.count("*").alias("expenses"), F.sum(-F.col("amount")).alias("total"))
        .orderBy("deduction_class", "category")
    )


def recent_deductions(
    transactions: DataFrame, year: int, limit: int = 10, classes: dict[str, str] | None = None
) -> DataFrame:
    """The newest deductible expenses of each class. Each task keeps its own newest few before the shuffle."""
    newest = Window.partitionBy("deduction_class").orderBy(F.desc("transaction_date"), F.desc("id"))
    return (
        deductible(transactions, year, classes)
        .select("deduction_class", "transaction_date", "id", "category", "description", "amount")
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= limit)
    )


def tax_report(
    documents: DataFrame, transactions: DataFrame, year: int, classes: dict[str, str] | None = None
) -> DataFrame:
    """Income, withholding, deduction totals and every deductible expense of a year, in long form with form lines."""
    lines = F.create_map(*[F.lit(item) for pair in FORM_LINES.items() for item in pair])

    def section(rows: DataFrame, name: Column, label: Column, total: Column, **extra: Column) -> DataFrame:
        nothing = {"transaction_date": F.lit(None).cast("date"), "id": F.lit(None).cast("bigint")}
        return rows.select(
            name.alias("section"), label.alias("label"), total.cast("decimal(28,2)").alias("total"),
            F.try_element_at(lines, label).alias("form_line"),
            *[extra.get(c, nothing[c]).alias(c) for c in nothing],
        )

    pairs = ", ".join(f"'{c}', {c}" for c in MEASURES)
    sums = tax_summary(documents.filter(F.col("tax_year") == year)).filter("document_type IS NULL")
    income = sums.selectExpr(f"stack({len(MEASURES)}, {pairs}) AS (label, total)")
    kind = F.when(F.col("label") == "federal_tax_withheld", "withholding").otherwise("income")
    totals = deduction_totals(transactions, year, classes).groupBy("deduction_class").agg(F.sum("total").alias("total"))
    expenses = deductible(transactions, year, classes)
    return (
        section(income, kind, F.col("label"), F.col("total"))
        .unionByName(section(totals, F.lit("deduction"), F.col("deduction_class"), F.col("total")))
        .unionByName(
            section(expenses, F.lit("expense"), F.col("deduction_class"), -F.col("amount"),
                    transaction_date=F.col("transaction_date"), id=F.col("id").cast("bigint"))
        )
    )
