"""Reading, typing and writing tables; fields out of collected pages."""
