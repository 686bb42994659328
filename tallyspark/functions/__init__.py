"""Column-level functions: parsing, keys, signs, classes."""

from tallyspark.functions.common import as_col, strip
from tallyspark.functions.numbers import (
    MONEY_TYPE, PARSE_TYPE, SUM_TYPE, net_amount, parse_number_comma, parse_number_it,
    parse_number_mixed, parse_number_plain, sign_multiplier, signed_amount, taxable, to_money,
)
from tallyspark.functions.dates import (
    date_text, extend_period, month_of, parse_date, quarter_from_name,
    quarter_end_col, quarter_start_col,
)
from tallyspark.functions.text import (
    amount_key, blank_null_tokens, is_empty_id, normalize_id, text_key,
)
from tallyspark.functions.codes import (
    ALLOWED_CODES, ALT_ALLOWED_CODES, CLASS_CODES, ELECTRONIC, PAPER, SELF_INVOICE, clean_code,
    code_class, code_dimension, code_rows, is_allowed, summary_class,
)
