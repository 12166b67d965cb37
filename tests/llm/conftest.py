import pytest


@pytest.fixture(scope="session")
def larger(data):
    """The tables of the next size."""
    return data.replace("sf0.001", "sf0.01")
