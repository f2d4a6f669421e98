"""Incremental form of the batch daily aggregate (the reference has no streaming).

``daily_consumption_stream`` is A6 (lenient daily mean x 24, exact, rounded
half-to-even) applied to a stream of hourly readings: the local day is an
event-time window, a watermark bounds the state, and each (postal code, day)
is emitted once, when the watermark passes the end of the day.
"""

from wattlane.streaming.daily import daily_consumption_stream

__all__ = ["daily_consumption_stream"]
