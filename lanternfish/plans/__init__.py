"""Views over the test tables and composed pipelines."""
