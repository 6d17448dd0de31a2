"""pulseboard: product-usage reports as lazy Spark DataFrames.

Every report takes a :class:`~pulseboard.sources.bindings.Domain` (the nine
domain frames) plus plain parameters and returns an unevaluated DataFrame.
Nothing is collected to the driver; the caller decides on the action.
"""

from pulseboard.session import build_session

__all__ = ["build_session"]
