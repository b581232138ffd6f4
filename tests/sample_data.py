"""Where the tests find the given tables."""

SF_DIR = "/root/testdata/sf0.001"
