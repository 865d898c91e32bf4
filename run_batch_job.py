"""spark-submit entry point of the file job (B1 with the B4 arguments) and of training.

    spark-submit --py-files urlsieve.zip run_batch_job.py --input 'in/*.csv' --model /shared/model
    spark-submit --py-files urlsieve.zip run_batch_job.py train --input 'labelled/*.csv' --output /shared/run1
"""

import sys

from urlsieve.plans.jobs import main, train_main

if __name__ == "__main__":
    train_main(sys.argv[2:]) if sys.argv[1:2] == ["train"] else main(sys.argv[1:])
