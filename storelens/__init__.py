"""storelens: Spark jobs for the data work behind an online-store assistant.

Every public function takes and returns DataFrames; nothing is collected to the
driver except bounded dimension tables whose size is checked first.
"""

from storelens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
