"""Clinical tables, code lists and result files."""

from cohortspark.sources.codes import CodeLists, csv_codes, in_codes, listed_events, literal_codes, literal_table
from cohortspark.sources.files import ResultSet, read_csv, write_csv, write_table
from cohortspark.sources.tables import ClinicalTables, contains_any, dynamic_codes, of_persons
from cohortspark.sources.templates import run_template

__all__ = ["ClinicalTables", "CodeLists", "ResultSet", "contains_any", "csv_codes", "dynamic_codes", "in_codes",
           "listed_events", "literal_codes", "literal_table", "of_persons", "read_csv", "run_template", "write_csv", "write_table"]
