from shopledger.functions.dates import *  # noqa: F401,F403
from shopledger.functions.numbers import *  # noqa: F401,F403
from shopledger.functions.texts import *  # noqa: F401,F403
