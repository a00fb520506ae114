
from . import queries  # noqa: F401  (whatever module a worker asks for first, all are registered in one order)
