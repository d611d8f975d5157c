"""Registered queries over files and streams. Each writes files derived from the tables into the shared folder and
reads them back."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.checks.registry import check
from tallyforge.checks.text import redact_sql
from tallyforge.operators.recurring import recurring_profile
from tallyforge.plans import reports
from tallyforge.session import shared_folder
from tallyforge.sources import files, store
from tallyforge.streaming.ingest import Ledger, import_new_files

_ROW_TEXT = ", ".join(
    f"nullif({c}, '') AS {c}" for c in ("date", "posted_date", "amount", "debit", "description", "memo")
)


@check("src02_delimited_rows", "raw_rows", f"SELECT cast(row_id AS varchar) AS row_id, {_ROW_TEXT} FROM raw_rows")
def _(i):
    folder = shared_folder(i.spark, "rows")
    rows = i.raw_rows
    first = rows.filter("source_file = 'export_O.csv'").select("row_id", "date", "amount", "description")
    second = rows.filter("source_file <> 'export_O.csv'").select("row_id", "posted_date", "debit", "memo")
    first.write.csv(f"{folder}/a", header=True, sep=";")
    second.write.csv(f"{folder}/b", header=True, sep=";")
    read = files.read_rows(i.spark, [f"{folder}/a", f"{folder}/b"], ";")
    return read.select("row_id", "date", "posted_date", "amount", "debit", "description", "memo")


@check("src01_whole_texts", sql="SELECT text, count(*) AS n FROM conversations GROUP BY text")
def _(i):
    folder = shared_folder(i.spark, "texts")
    # Files of a bounded number of lines, so that none grows with the table; the lines are the texts themselves,
    # newlines written as \\u0001.
    packed = i.conversations.select(F.translate("text", "\n", "\u0001").alias("value"))
    packed.write.option("maxRecordsPerFile", 500).text(folder)
    lines = files.read_texts(i.spark, folder).select(F.explode(F.split("text", "\n", -1)).alias("text"))
    texts = lines.filter("text <> ''").select(F.translate("text", "\u0001", "\n").alias("text"))
    return texts.groupBy("text").agg(F.count("*").alias("n"))


# File names as an importer's folder would hold them: many kinds, some already processed.
_NAMES = """
, listing AS (SELECT '/in/' || n AS path, n AS file_name FROM (SELECT concat('doc', doc_id, CASE doc_id % 5
  WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' WHEN 3 THEN '-sanitized.txt' ELSE '.csv' END) AS n
  FROM documents)),
done AS (SELECT concat('doc', doc_id, '-sanitized', CASE doc_id % 5 WHEN 0 THEN '.txt' ELSE '.csv' END) AS copy
  FROM documents WHERE n_chars % 2 = 0)
"""


@check("src03_pending_files", sql="WITH" + _NAMES.strip()[1:] + """
SELECT path, file_name FROM listing WHERE NOT ends_with(file_name, '.docx')
 AND NOT ends_with(file_name, '-sanitized.txt')
 AND regexp_replace(file_name, '[.].*', '') || '-sanitized.' || lower(split_part(file_name, '.', 2))
   NOT IN (SELECT copy FROM done)""")
def _(i):
    kind = F.element_at(
        F.array(*map(F.lit, (".TXT", ".pdf", ".docx", "-sanitized.txt", ".csv"))), (F.col("doc_id") % 5 + 1).cast("int")
    )
    name = F.concat(F.lit("doc"), F.col("doc_id"), kind)
    listing = i.documents.select(F.concat(F.lit("/in/"), name).alias("path"), name.alias("file_name"))
    copy_kind = F.when(F.col("doc_id") % 5 == 0, ".txt").otherwise(".csv")
    done = i.documents.filter("n_chars % 2 = 0").select(
        F.concat(F.lit("doc"), F.col("doc_id"), F.lit("-sanitized"), copy_kind).alias("file_name")
    )
    return files.pending_files(listing, done)


@check("src03_listed_files", sql="SELECT doc_id, source FROM documents WHERE source <> 'src0'")
def _(i):
    """Lists a real folder, of which the files of one source have processed copies, and reads what is left."""
    folder = shared_folder(i.spark, "listing")
    docs = i.documents.select("doc_id", "source")
    docs.filter("source = 'src0'").write.csv(f"{folder}/a", header=True)
    docs.filter("source <> 'src0'").write.csv(f"{folder}/b", header=True)
    listing = files.list_files(i.spark, folder)
    copy = F.regexp_replace("file_name", r"\.csv$", "-sanitized.csv").alias("file_name")
    pending = files.pending_files(listing, listing.filter(F.col("path").contains(f"{folder.rsplit('/', 1)[1]}/a/")).select(copy))
    rows = i.spark.read.schema("doc_id long, source string").option("recursiveFileLookup", "true").csv(folder, header=True)
    named = rows.select("doc_id", "source", F.col("_metadata.file_name").alias("file_name"))
    return named.join(pending.select("file_name"), "file_name", "left_semi").select("doc_id", "source")


@check("src04_stored_ledger", "transactions", """
SELECT id, source_file, cast(transaction_date AS varchar) AS transaction_date, cast(amount AS double) AS amount,
 merchant_name, category, reference_number, is_recurring FROM transactions""")
def _(i):
    folder = shared_folder(i.spark, "ledger")
    files.write_table(i.transactions, folder, schemas.TRANSACTIONS)
    return files.read_table(i.spark, folder, schemas.TRANSACTIONS).select(
        "id", "source_file", "transaction_date", "amount", "merchant_name", "category", "reference_number", "is_recurring"
    )


@check("src04_months_of_ledger", "transactions", """
SELECT id, cast(transaction_date AS varchar) AS transaction_date, cast(amount AS double) AS amount, category FROM transactions
WHERE transaction_date BETWEEN DATE '1996-11-15' AND DATE '1997-12-10'""")
def _(i):
    """A ledger laid out by month, and some months of it."""
    folder, dates = shared_folder(i.spark, "ledger"), (dt.date(1996, 11, 15), dt.date(1997, 12, 10))
    files.write_table(i.transactions, folder, schemas.TRANSACTIONS, "transaction_date", ("amount",))
    read = files.read_table(i.spark, folder, schemas.TRANSACTIONS, "transaction_date", *dates)
    return read.select("id", "transaction_date", "amount", "category")


@check("src06_replaced_on_disk", "transactions", """
SELECT source_file, category, count(*) AS n, sum(amount)::DOUBLE AS total FROM (
  SELECT source_file, category, amount FROM transactions WHERE source_file = 'stmt_F.csv'
  UNION ALL SELECT source_file, category, amount * 2 FROM transactions WHERE source_file = 'stmt_O.csv' AND amount > 0)
GROUP BY ALL""")
def _(i):
    """One file is imported again with other rows and one without any; the third stays."""
    folder, ledger = shared_folder(i.spark, "by-file"), i.transactions
    store.write_by_file(ledger, folder, schemas.TRANSACTIONS)
    again = ledger.filter("source_file = 'stmt_O.csv' AND amount > 0").withColumn("amount", (F.col("amount") * 2).cast("decimal(18,2)"))
    replaced = ledger.select("source_file").filter("source_file <> 'stmt_F.csv'").distinct()
    store.replace_files(again, replaced, folder, schemas.TRANSACTIONS)
    rows = store.read_by_file(i.spark, folder, schemas.TRANSACTIONS)
    return rows.groupBy("source_file", "category").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@check("snk01_written_csv", "transactions", """
SELECT cast(transaction_date AS varchar) AS transaction_date, cast(amount AS varchar) AS amount, description,
 merchant_name, category, source_file FROM transactions""")
def _(i):
    folder = shared_folder(i.spark, "csv")
    reports.write_csv(reports.export_rows(i.transactions), folder)
    read = i.spark.read.csv(folder, header=True, inferSchema=False)
    return read.select("transaction_date", "amount", "description", "merchant_name", "category", "source_file")


@check("snk03_written_json", "transactions", """
SELECT id, cast(amount AS double) AS amount, description, merchant_name, is_recurring FROM transactions""")
def _(i):
    folder = shared_folder(i.spark, "json")
    reports.write_json(i.transactions, folder)
    schema = "id long, amount decimal(18,2), description string, merchant_name string, is_recurring boolean"
    return i.spark.read.schema(schema).json(folder)


def _imported(i, view: str, columns: list[str], *parts: str, fold: int = 8):
    """Imports sets of statement files one after the other, and runs the import once more, which adds nothing."""
    folder = shared_folder(i.spark, "ingest")
    rows = getattr(i, view).select(*columns)
    ledger = Ledger(i.spark, f"{folder}/ledger", rows.schema, ["id"], fold)
    for part in (*parts, None):
        if part:
            rows.filter(part).write.mode("append").parquet(f"{folder}/in")
        import_new_files(ledger, f"{folder}/in", f"{folder}/checkpoint")
    return ledger, files.list_files(i.spark, f"{folder}/in")


_PLAIN = ["id", "transaction_date", "amount", "description", "merchant_name"]
_HALVES = ("transaction_date < DATE '2000-01-01'", "transaction_date >= DATE '1999-01-01'")


@check("inc01_exactly_once", "plain_rows", f"""
SELECT cast(0 AS bigint) AS files_missing, cast(0 AS bigint) AS files_twice,
 (SELECT count(*) FROM plain_rows WHERE {_HALVES[0]}) + (SELECT count(*) FROM plain_rows WHERE {_HALVES[1]})
 AS row_count""")
def _(i):
    ledger, listing = _imported(i, "plain_rows", _PLAIN, *_HALVES)
    log = ledger.import_log().withColumn("file_name", F.element_at(F.split("file_path", "/"), -1))
    known = listing.filter(F.col("file_name").endswith(".parquet")).select("file_name")
    missing = known.join(log, "file_name", "left_anti").agg(F.count("*")).scalar()
    return log.agg(F.sum("row_count").alias("row_count"), F.count("*").alias("n"), F.countDistinct("file_path").alias("m")).select(
        missing.alias("files_missing"), (F.col("n") - F.col("m")).alias("files_twice"), "row_count"
    )


@check("inc02_overlapping_statements", "plain_rows", """
SELECT DISTINCT cast(transaction_date AS varchar) AS transaction_date, amount::DOUBLE AS amount,
 coalesce(merchant_name, description) AS who FROM plain_rows""")
def _(i):
    rows = _imported(i, "plain_rows", _PLAIN, *_HALVES)[0].rows()
    return rows.select("transaction_date", "amount", F.coalesce("merchant_name", "description").alias("who"))


#: Three overlapping statements: the second repeats some months of the first, the third some of the second.
_THIRDS = (
    "transaction_date < DATE '1994-07-01'",
    "transaction_date >= DATE '1994-04-01' AND transaction_date < DATE '1997-01-01'",
    "transaction_date >= DATE '1996-10-01'",
)


def _marks_after(name: str, *parts: str) -> str:
    """SQL of the merchants that are recurring in the rows of some statements."""
    return f"""
{name}_u AS (SELECT DISTINCT merchant_name, transaction_date, amount FROM recurring_ledger WHERE {' OR '.join(f'({p})' for p in parts)}),
{name}_p AS (SELECT merchant_name, cast(sum(amount) AS double) / count(amount) AS m, count(*) AS n FROM {name}_u GROUP BY 1
  HAVING count(*) >= 3),
{name} AS (SELECT merchant_name FROM {name}_u JOIN {name}_p USING (merchant_name) GROUP BY merchant_name, n
  HAVING sum(CASE WHEN abs(cast(amount AS double) - m) / abs(m) <= 0.05 THEN 1 ELSE 0 END) >= n * 0.7)"""


# A mark stays once any statement gave it, also where all rows together would not.
@check("inc03_refreshed_flags", "recurring_ledger", f"""
, {_marks_after("one", _THIRDS[0])}, {_marks_after("two", *_THIRDS[:2])}, {_marks_after("three", *_THIRDS)},
marks AS (SELECT merchant_name, min(b) AS since FROM (SELECT merchant_name, 1 AS b FROM one UNION ALL SELECT merchant_name, 2 FROM two
  UNION ALL SELECT merchant_name, 3 FROM three) GROUP BY 1)
SELECT since IS NOT NULL AS is_recurring, since, merchant_name IN (SELECT merchant_name FROM three) AS still, count(*) AS n,
 sum(amount)::DOUBLE AS total FROM three_u LEFT JOIN marks USING (merchant_name) GROUP BY ALL""")
def _(i):
    ledger, _ = _imported(i, "recurring_ledger", _PLAIN, *_THIRDS, fold=2)
    own = [ledger.marks.change(b).withColumn("b", F.lit(b + 1)) for b in range(len(_THIRDS))]
    since = reduce(DataFrame.unionByName, own).groupBy("merchant_name").agg(F.min("b").alias("since"))
    now = recurring_profile(ledger.rows()).filter("is_recurring").select("merchant_name", F.lit(True).alias("still"))
    # What is looked up belongs to a merchant, so its rows are summed before.
    flagged = ledger.flagged().groupBy("merchant_name", "is_recurring").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    marked = flagged.join(since, "merchant_name", "left").join(now, "merchant_name", "left")
    return marked.groupBy("is_recurring", "since", F.coalesce("still", F.lit(False)).alias("still")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )


@check("snk07_redacted_copies", sql=f"""
SELECT cast(doc_id AS varchar) AS source_file, {redact_sql('text')} AS text,
 contains({redact_sql('text')}, '_REDACTED]') AS was_redacted FROM documents""")
def _(i):
    folder = shared_folder(i.spark, "redacted")
    files.write_redacted(i.documents.select(F.col("doc_id").cast("string").alias("source_file"), "text"), folder)
    texts = i.spark.read.parquet(f"{folder}/texts").select("source_file", "text")
    audit = i.spark.read.parquet(f"{folder}/audit")
    return texts.join(audit, "source_file").select("source_file", "text", (F.size("patterns") > 0).alias("was_redacted"))
