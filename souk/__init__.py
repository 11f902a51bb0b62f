"""souk: market-survey analytics (indicators, validation, falsification checks,
comparison) as distributed PySpark DataFrame / SQL jobs.

Entry points: ``souk.plans.analysis.analyse``, ``souk.plans.validation.validate``,
``souk.plans.comparison.compare_runs`` and ``python -m souk``.
"""

__version__ = "0.1.0"
