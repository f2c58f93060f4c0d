import pytest


@pytest.fixture
def files(spark):
    """Files from (file_id, path, content), with a clashing extra column and repeated deliveries."""

    def make(*rows):
        return spark.createDataFrame([(i, "r/x", p, None, c, "clash") for i, p, c in rows], "file_id long, repo string, file_path string, language string, content string, text string")

    return make
