"""Linear algebra on one thread.

Tasks share the cores already, and the threads of the library that numpy brings
can wait for each other for ever in a process that has started a JVM.
"""

from __future__ import annotations

import ctypes
from contextlib import suppress
from pathlib import Path

import numpy as np


def single_thread() -> None:
    """Hold the library that comes with numpy to one thread; another one is left as it is."""
    for file in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        with suppress(OSError, AttributeError):
            ctypes.CDLL(str(file)).scipy_openblas_set_num_threads64_(1)
