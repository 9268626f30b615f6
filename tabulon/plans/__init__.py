

from . import queries  # noqa: E402, F401, I001
from . import audits, details, files, streams, studies  # noqa: E402, F401
