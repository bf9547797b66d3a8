from freshlane.oracle.base import with_base  # noqa: F401
