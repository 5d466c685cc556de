"""Counterpoise: class rebalancing of labelled tables as Spark jobs.

Everything takes DataFrames and returns DataFrames; see README.md for the map.
"""

from counterpoise.operators.neighbors import knn_index, knn_join, open_index
from counterpoise.plans.clean import link_clean, oversample_then_clean
from counterpoise.plans.oversample import oversample

__all__ = ["knn_index", "knn_join", "link_clean", "open_index", "oversample", "oversample_then_clean"]
