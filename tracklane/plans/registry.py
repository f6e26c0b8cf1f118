"""All queries and their SQL, by name."""

from . import models, panels, prepare, relations  # noqa: F401
from .views import QUERIES, SQL  # noqa: F401
