"""Spark-native preparation, scoring and evaluation of tool-calling corpora.

Every public function maps ``DataFrame -> DataFrame`` or ``Column -> Column``.
Nothing is collected to the driver in a core path and no row-at-a-time Python
runs in the hot path: extraction, rewards, advantages and metrics are plain
Catalyst expressions, aggregations, joins and windows.
"""

from toolframe.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
