"""What several test modules share. Not in conftest.py: folders of tests have one each."""


def rows(df):
    return [tuple(r) for r in df.collect()]
