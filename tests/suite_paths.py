"""Where the suite reads its tables."""

SF = "/root/testdata/sf0.001"
