from crowdlake.functions.scalars import *  # noqa: F401,F403
from crowdlake.functions.registry import register_sql_functions  # noqa: F401
