"""Column-expression helpers."""
from jobgrid.functions.text import *  # noqa: F401,F403
