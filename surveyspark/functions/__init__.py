from .binning import (LABELS_LOW_FIRST, REFERENCE_LABELS, bin_index, bin_label, bin_lower,
                      bin_upper)
from .calendar import case_month, case_year
from .predicates import drop_codes, in_interval, keep_codes, not_equal

__all__ = ["LABELS_LOW_FIRST", "REFERENCE_LABELS", "bin_index", "bin_label", "bin_lower",
           "bin_upper", "case_month", "case_year", "drop_codes", "in_interval",
           "keep_codes", "not_equal"]
