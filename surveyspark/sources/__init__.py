from .delimited import CsvScan, infer_types, scan_csv
from .survey import (CLEAN_COLUMNS, LABEL, MODEL_FEATURES, SURVEY_KEY, SURVEY_SQL,
                     forget_tables, source_version, survey, survey_table, with_survey)
from .tables import TABLES, read_csv, read_table, table_path, write_csv

__all__ = ["CLEAN_COLUMNS", "LABEL", "MODEL_FEATURES", "SURVEY_KEY", "SURVEY_SQL",
           "TABLES", "CsvScan", "infer_types", "scan_csv", "read_csv", "read_table", "forget_tables", "source_version",
           "survey", "survey_table", "table_path", "with_survey", "write_csv"]
