"""Business analytics over whole tables, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from ledgerlight.session import build_session, ensure_checkpoint_dir, tables_removed

# Functions sent to tasks carry their code with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "ensure_checkpoint_dir", "tables_removed"]
