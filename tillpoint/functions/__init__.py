from tillpoint.functions.expr import *  # noqa: F401,F403
from tillpoint.functions.args import *  # noqa: F401,F403
