"""DataFrame operators: joins, groupings, ordered scans and model fits."""

from waveline.numeric import single_thread

single_thread()
