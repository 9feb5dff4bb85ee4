"""Streaming adapter.

The analyses are batch reports (no windowed or stateful logic exists in
them), so streaming support is an adapter: billing lines arriving on a
stream are added to a line table, one folder per micro-batch, and the batch
operators run per micro-batch over the lines seen so far.  A replayed batch
replaces its folder, so reports do not count lines twice.
"""

from .micro_batch import refresh_report_per_batch  # noqa: F401
