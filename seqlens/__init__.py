"""seqlens — entity-sequence cohort analytics on Spark DataFrames.

Layers:

* ``sources``   — readers with explicit schemas, the test-table adapter, sinks
* ``functions`` — Column-level helpers (hex decode, address normalisation, bucketing)
* ``operators`` — DataFrame operators (game fact, skew-aware sequencing, exact
  grouped medians, distributed quantile tiers, cohorts, quality checks)
* ``plans``     — the user-level reports built from the operators
* ``llm``       — operators for training-data corpora; nothing else imports it

The cohort analytics are DataFrame API and built-in functions without Python
UDFs; some corpus operators use Arrow functions.
"""

from seqlens.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
