"""Where the driver's tables lie (a module of its own: several folders have a conftest)."""

SF_SMALL = "/root/testdata/sf0.001"
