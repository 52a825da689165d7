"""Column expressions shared by the operators."""

from cohortspark.functions.dates import (anniversary_years, birth_date, duration_years, exposure_end,
                                         in_lookback, within_days)
from cohortspark.functions.missing import if_else, na_agg
from cohortspark.functions.numbers import as_number, first_word_number, stripped_number

__all__ = ["anniversary_years", "as_number", "birth_date", "duration_years", "exposure_end",
           "first_word_number", "if_else", "in_lookback", "na_agg", "stripped_number", "within_days"]
