from freshlane.sources.driver import read_table  # noqa: F401
from freshlane.sources.retail import Retail  # noqa: F401
