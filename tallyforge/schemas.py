"""Fixed schemas of the stored ledger tables. Money is DECIMAL(18,2), dates are DATE."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(18, 4)


def _schema(spec: str) -> T.StructType:
    kinds = {
        "s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "m": MONEY, "r": RATE,
        "d": T.DateType(), "t": T.TimestampType(), "b": T.BooleanType(),
    }
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, kinds[kind], True) for name, kind in fields])


TRANSACTIONS = _schema(
    "id:l source_file:s transaction_date:d amount:m description:s merchant_name:s category:s account_type:s "
    "bank_name:s transaction_type:s reference_number:s notes:s tags:s is_recurring:b"
)
IMPORTED_FILES = _schema("file_path:s file_type:s row_count:l notes:s import_date:t seq:l")
PAYSTUBS = _schema(
    "source_file:s pay_date:d pay_period_start:d pay_period_end:d employer_name:s gross_pay:m regular_hours:r "
    "overtime_hours:r regular_rate:r overtime_rate:r bonus:m commission:m deductions_json:s total_deductions:m "
    "net_pay:m ytd_gross:m ytd_net:m ytd_taxes:m"
)
ACCOUNT_BALANCES = _schema(
    "id:l source_file:s statement_date:d balance:m available_credit:m credit_limit:m minimum_payment:m "
    "payment_due_date:d apr:r account_type:s bank_name:s"
)
INVESTMENT_ACCOUNTS = _schema(
    "account_key:l source_file:s account_type:s bank_name:s statement_date:d portfolio_value:m"
)
HOLDINGS = _schema("account_key:l statement_date:d ticker:s security_name:s quantity:r market_value:m")
INVESTMENT_TRANSACTIONS = _schema(
    "account_key:l transaction_date:d transaction_type:s security_ticker:s quantity:r price:r amount:m"
)
TAX_DOCUMENTS = _schema(
    "source_file:s document_type:s tax_year:i payer_name:s employer_name:s interest_income:m ordinary_dividends:m "
    "qualified_dividends:m total_capital_gain:m proceeds:m cost_basis:m gain_loss:m wages:m federal_tax_withheld:m "
    "social_security_wages:m social_security_tax:m medicare_wages:m medicare_tax:m"
)
BUDGET_LOG = _schema("category:s month:i year:i budget_amount:m is_active:b updated_at:d seq:l")
GOAL_LOG = _schema(
    "id:l goal_name:s goal_type:s target_amount:m current_amount:m target_date:d start_date:d is_active:b "
    "description:s updated_at:d seq:l"
)
