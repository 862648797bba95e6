"""Annotated matrices and a small dataframe grammar on Spark."""

from .errors import AxisFrameError, DuplicateNameError, IncompatibleAxisError, JoinRelationshipError, NameRepairError, SelectionError, SizeMismatchError, UnknownColumnError, UnknownSourceError
from .functions.expr import Expr, average_rank, between, case_match, case_when, coalesce, col, cum_max, cum_min, cum_prod, cum_sum, cumall, cumany, cume_dist, cummean, dense_rank, desc, first, if_else, is_na, lag, last, lead, lit, max, max_rank, mean, median, min, min_rank, n, n_distinct, na_if, near, nth, ntile, obs_names, percent_rank, recode, replace_na, row_number, sd, sum, var_names  # noqa: A004
from .functions.selectors import across, all_of, any_of, contains, ends_with, everything, if_all, if_any, is_numeric, last_col, matches, num_range, pick, starts_with, where
from .operators.table import AxisTable, GroupedAxisTable
from .operators.tidy import chop, drop_na, extract, fill, hoist, nest, pack, pivot_longer, pivot_wider, separate, separate_rows, unchop, unite, unnest, unnest_longer, unnest_wider, unpack
from .operators.utilities import FeaturePresence, add_name_prefix, add_sample_meta, feature_present, get_palette, name_duplicates, rename_obs_names, rename_var_names, replace_name_suffix, sample_meta, sample_summary, store_palette, with_levels

__version__ = "0.1.0"
