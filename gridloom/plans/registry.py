"""Every lattice query by name, with its SQL where SQL can express it."""

from . import choices, cleaning, feeds, fields, places, space, studies  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
