"""Utility-billing analytics on Spark DataFrames.

Every report is a plain function ``f(tables, params) -> DataFrame`` that
returns typed numeric columns; text formatting lives in
``waterbook.plans.present`` and is applied as a last, separate step.
"""

from waterbook.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
