"""addrgraph: contact extraction and link-crawl analytics as Spark jobs.

Pages, documents and discovery records are DataFrames; every operator takes
DataFrames and returns DataFrames.  Column-level rules live in
``addrgraph.functions``, table operators in ``addrgraph.operators``, sources
and sinks in ``addrgraph.sources``, multi-step plans (the breadth-first crawl,
derived fixtures) in ``addrgraph.plans`` and the streaming variants in
``addrgraph.streaming``.
"""

from addrgraph.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
