"""Where the frames come from: the domain derived from the driver's tables."""
