"""kabund: k-mer abundance analytics on Spark DataFrames."""

from kabund.params import IndexParams, QueryFormat, Quantiser, Sampling
from kabund.plans.engine import KmerIndex

__version__ = "0.2.0"
__all__ = ["IndexParams", "KmerIndex", "Quantiser", "QueryFormat", "Sampling"]
