"""Values both sides of the contract use; small enough to leave rows at every test scale."""

MIN_DRIVES = 50
MIN_DISTRIBUTION = 10
DEPLOY_COUNT_MIN = 5
