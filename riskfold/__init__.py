"""riskfold: tabular credit-risk analytics as Spark DataFrame operators.

Every public operator is a plain ``DataFrame -> DataFrame`` function (or a
``Column`` builder) so it composes with ``df.transform``. The heavy lifting
is done by Spark SQL / MLlib; Python code only builds plans and holds fitted
state whose size is bounded by the number of columns.
"""

__version__ = "0.1.0"
