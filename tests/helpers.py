"""Values shared by the tests."""
import datetime as dt

SF_SMALL = "/root/testdata/sf0.001"


def ts(s):
    return None if s is None else dt.datetime.fromisoformat(s)
