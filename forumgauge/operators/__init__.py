"""Operators: plain functions from DataFrames to a DataFrame, usable with ``df.transform``."""

from .aggregates import *  # noqa: F401,F403
from .columns import *  # noqa: F401,F403
from .evaluation import *  # noqa: F401,F403
from .joins import *  # noqa: F401,F403
from .relate import *  # noqa: F401,F403
from .reshape import *  # noqa: F401,F403
from .scoring import *  # noqa: F401,F403
from .terms import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
from .topics import *  # noqa: F401,F403
from .topk import *  # noqa: F401,F403
from .windows import *  # noqa: F401,F403
