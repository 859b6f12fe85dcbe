"""Strict parsing of exported text values.

Each parser is a SQL expression over a column name, yielding ``struct<value, problem>``: a spec of
dozens of columns then becomes one ``selectExpr``.
"""

from __future__ import annotations

# Fixed patterns: the accepted text of each kind of value.
PLAIN_MONEY = r"^\s*[+-]?(\d+(\.\d{0,2}0*)?|\.\d{1,2}0*)\s*$"
PLAIN_DECIMAL = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
TINY_DIGITS = r"\.\d{12}0*[1-9]|[1-9].*[eE]-\d{2}"
MONTH_LABEL = r"^\d{4}-(0[1-9]|1[0-2])$"
FIRST_OF_MONTH = r"^(\d{4}-(?:0[1-9]|1[0-2]))-01(?:[ T]00:00:00(?:\.0+)?)?$"


def _parsed(column: str, value: str, accepted: str, complaint: str) -> str:
    """Empty text is NULL, not a problem; text that is not accepted is a problem and has no value."""
    return (f"named_struct('value', if(coalesce({accepted}, false), {value}, NULL), "
            f"'problem', if({column} <> '' and not coalesce({accepted}, false), concat('{complaint}: ', {column}), NULL))")


def money_cents(column: str) -> str:
    """'1234.56' -> 123456. Exponents, sub-cent digits and non-numbers are problems."""
    shaped = f"{column} rlike r'{PLAIN_MONEY}'"
    cents = f"try_cast(try_cast(trim({column}) as decimal(36,2)) * 100 as bigint)"
    return _parsed(column, cents, f"({shaped} and {cents} is not null)", "not a plain money value")


def whole_count(column: str) -> str:
    """Non-negative integers; '5.0' and '1e3' are whole, '5.5' and '-1' are not.

    Digits past the twelfth decimal would be rounded away by the cast, so they must be zeros.
    """
    exact = f"try_cast(trim({column}) as decimal(38,12))"
    whole = f"try_cast({exact} as bigint)"
    accepted = (f"({column} rlike r'{PLAIN_DECIMAL}' and not {column} rlike r'{TINY_DIGITS}' "
                f"and {exact} = {whole} and {exact} >= 0)")
    return _parsed(column, whole, accepted, "not a non-negative integer")


def finite_number(column: str) -> str:
    value = f"try_cast(trim({column}) as double)"
    accepted = f"({column} rlike r'{PLAIN_DECIMAL}' and abs({value}) < double('infinity'))"
    return _parsed(column, value, accepted, "not a finite number")


def plain_text(column: str) -> str:
    return f"named_struct('value', nullif({column}, ''), 'problem', cast(NULL as string))"


PARSERS = {"money": money_cents, "count": whole_count, "number": finite_number, "text": plain_text}


def month_problem(label: str = "month_label", first_day: str = "purchase_month") -> str:
    """NULL when the label is canonical YYYY-MM and names the month of ``first_day``."""
    month = f"regexp_extract(coalesce({first_day}, ''), r'{FIRST_OF_MONTH}', 1)"
    return (f"CASE WHEN NOT coalesce({label} rlike r'{MONTH_LABEL}', false) THEN 'label is no YYYY-MM' "
            f"WHEN {month} = '' THEN 'date is no first of a month' "
            f"WHEN {month} <> {label} THEN 'label and date name different months' END")
