"""cellframe: single-cell expression analytics as Spark DataFrame jobs.

Cells are rows, genes are tokens.  Every operator is a function from
DataFrame(s) to a DataFrame; nothing is collected to the driver except
tiny parameter tables whose size is checked first.
"""

from cellframe.config import Params

__all__ = ["Params"]
