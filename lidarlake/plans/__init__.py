from lidarlake.plans import algebra, audit, contracts, estimator, guidance, machines, mapping, planner, retrieval

MODULES = (audit, mapping, planner, retrieval, algebra, machines, estimator, guidance, contracts)
