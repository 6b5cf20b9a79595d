from gridcast.functions.time import (epoch_seconds, from_epoch_seconds, hour_of_day,
                                    shift, week_day, weekend_sat_sun)
from gridcast.functions.transforms import inverse_transform, log_transform

__all__ = ["epoch_seconds", "from_epoch_seconds", "hour_of_day", "shift", "week_day",
           "weekend_sat_sun", "log_transform", "inverse_transform"]
