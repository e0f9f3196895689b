"""sparkrec: recommendation analytics on Spark DataFrames.

Every public operator is ``DataFrame -> DataFrame`` or ``Column -> Column`` and
stays lazy; Python workers are used only for matrix work (blocked top-k search,
sequence-model inference) and order-dependent vector folds.
"""

__version__ = "0.1.0"
