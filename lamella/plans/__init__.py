"""Plan building blocks shared by the operators: spooled tables and distributed numbering."""

from lamella.plans.numbering import number_rows, ordered_lag, ordered_total
from lamella.plans.spool import shared_dir, spool

__all__ = ["number_rows", "ordered_lag", "ordered_total", "shared_dir", "spool"]
