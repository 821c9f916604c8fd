"""riskloom: relational credit-risk features, applicant graphs and scoring on Spark."""
